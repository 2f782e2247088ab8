"""Quality rules as weak supervision, in built-in expressions only.

Every rule votes good (1), bad (0) or abstains (null). Rules err independently given the hidden quality; each has two
accuracies where it votes: on good documents and on bad ones (each kind of junk offends few rules, so a vote for good says
little; so the rules overlap: the odd ones see most kinds of junk). Expectation-maximisation over the counts of vote patterns (at most 3**rules of them, whatever the corpus)
estimates accuracies and the share of good documents; a document is kept if its posterior probability of being
good is at least ``KEEP``.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from propensia.session import stage

SPACE = r"[ \t-\r]"
SYMBOLS = r"[#*$%&|<>]"
#: an odd character is neither letter, mark, digit nor white space; the usual ones end or join parts of sentences
PLAIN = r"[\p{L}\p{M}\p{N}\s]+"
USUAL = r"[.,;:?'\"()\u2019-]"
WINDOW = 5
KEEP = 0.5
ROUNDS, START = 100, (0.8, 0.95, 0.4)
BOUNDS, EDGE = (0.05, 0.999), 0.05

#: rule -> (measure, bad if above, good if up to); shares of a text's words, lines or letters, less what short texts may hold
SHARES = {
    "symbols": ("n_symbols / n_words", 0.30, 0.10),
    "duplicate_lines": ("n_dup_lines / n_lines", 0.30, 0.10),
    "repeated_words": ("n_repeat_words / n_words", 0.20, 0.05),
    "capitals": ("n_capitals / word_chars", 0.50, 0.20),
    "odd_characters": ("(n_odd - 4) / word_chars", 0.08, 0.05),
    "unusual_characters": ("(n_unusual - 2) / n_words", 0.30, 0.10),
}
#: rule -> (measure, bad below, good from, good up to, bad above)
RANGES = {
    "word_length": ("word_chars / n_words", 2.0, 3.0, 9.0, 14.0),
    "length": ("n_words", 10.0, 30.0, 100000.0, float("inf")),
}
RULES = [*SHARES, *RANGES]


class Model(NamedTuple):
    """Share of good documents; per rule the shares of good documents it finds good and of bad ones it finds bad."""

    good: float
    on_good: dict[str, float]
    on_bad: dict[str, float]

    def weights(self, rule: str) -> tuple[float, float]:
        """What a vote for bad and one for good add to the log odds of good."""
        g, b = self.on_good[rule], self.on_bad[rule]
        return math.log(1 - g) - math.log(b), math.log(g) - math.log(1 - b)


def _measured(rows: DataFrame) -> DataFrame:
    """Adds the counts to rows with the columns row and text.

    Arrays that lambdas read are columns of their own, so they are evaluated once per row.
    """
    text = F.coalesce("text", F.lit(""))
    n = F.size("ws")
    without = lambda c, pattern: F.length(F.regexp_replace(c, pattern, "")).cast("long")
    rows = rows.select("row", text.alias("text")).select(
        "row", F.array_remove(F.split("text", SPACE + "+"), "").alias("ws"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^ \t-\r]")).alias("ls"),
        F.regexp_replace("text", PLAIN, "").alias("odd"), (F.length("text") - without("text", "[A-Z]")).alias("n_capitals"),
    )
    n_odd = F.length("odd").cast("long")
    windows = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(1), n - WINDOW + 1), lambda i: F.xxhash64(F.slice("ws", i, WINDOW))))
    rows = rows.select(
        "row", n.cast("long").alias("n_words"), F.length(F.array_join("ws", "")).cast("long").alias("word_chars"),
        (n_odd - without("odd", SYMBOLS)).alias("n_symbols"), "n_capitals", n_odd.alias("n_odd"), without("odd", USUAL).alias("n_unusual"),
        F.size("ls").cast("long").alias("n_lines"), (F.size("ls") - F.size(F.array_distinct("ls"))).cast("long").alias("n_dup_lines"),
        windows.alias("hs"),
    )
    rows = rows.withColumn("placed", F.when(F.size(F.array_distinct("hs")) < F.size("hs"), F.sort_array(F.transform("hs", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    # windows whose hash stands next to an equal one in sorted order
    same = lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False))
    found = F.filter("placed", lambda x, j: same(x, F.get("placed", j - 1)) | same(x, F.get("placed", j + 1)))
    rows = rows.withColumn("again", F.sort_array(F.transform(found, lambda x: x["i"])))
    covered = F.aggregate(
        "again", F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last")),
        lambda s, i: F.struct((s["n"] + F.least(F.lit(WINDOW), i - s["last"])).alias("n"), i.alias("last")), lambda s: s["n"],
    )
    counts = F.struct(
        "n_words", "word_chars", "n_symbols", "n_dup_lines",
        F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"), "n_lines", "n_capitals", "n_odd", "n_unusual",
    )
    # a filter on the verdict is not pushed below this, where it would take all counts anew
    return rows.select("row", F.inline(F.array(counts)))


def _share(measure: str) -> Column:
    """Null where what is divided by is zero."""
    over, _, under = measure.partition(" / ")
    return F.try_divide(F.expr(over), F.expr(under or "1.0"))


def _vote(rule: str) -> Column:
    some = F.col("n_words") > 0
    if rule in SHARES:
        measure, bad, good = SHARES[rule]
        x = _share(measure)
        return F.when(some & (x > bad), 0).when(some & (x <= good), 1)
    measure, low, start, end, high = RANGES[rule]
    x = _share(measure)
    return F.when((x < low) | (x > high), 0).when((x >= start) & (x <= end), 1)


def _voted(rows: DataFrame) -> DataFrame:
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return rows.select("*", failed.alias("base_failed"), F.struct(*[_vote(r).cast("int").alias(r) for r in RULES]).alias("votes"))


def posterior(model: Model, votes: str = "votes") -> Column:
    """Probability that a document with these votes is good."""
    odds = F.lit(math.log(model.good) - math.log1p(-model.good))
    for rule in RULES:
        bad, good = model.weights(rule)
        vote = F.col(f"{votes}.{rule}")
        odds = odds + F.when(vote == 1, good).when(vote == 0, bad).otherwise(0.0)
    return 1 / (1 + F.exp(-odds))


def fit(voted: DataFrame, rounds: int = ROUNDS) -> Model:
    """Accuracies by expectation-maximisation on the counts of vote patterns of all rows.

    They stay within ``BOUNDS`` and a rule stays better than chance by ``EDGE`` (``on_good + on_bad >= 1 + EDGE``), which
    settles which class is the good one. Without rows the starting values are returned.
    """
    patterns = [(r["votes"], r["n"]) for r in voted.groupBy("votes").agg(F.count("*").alias("n")).orderBy("votes").collect()]
    total = sum(n for _, n in patterns)
    model = Model(START[0], dict.fromkeys(RULES, START[1]), dict.fromkeys(RULES, START[2]))
    for _ in range(rounds if total else 0):
        goods = 1.0
        seen = {r: [[START[1] * 2, 2.0], [START[2] * 2, 2.0]] for r in RULES}  # right and all votes, by true class
        for pattern, n in patterns:
            odds = math.log(model.good) - math.log1p(-model.good)
            for rule in RULES:
                if pattern[rule] is not None:
                    odds += model.weights(rule)[pattern[rule]]
            p = 1 / (1 + math.exp(-max(odds, -700.0)))
            goods += n * p
            for rule in RULES:
                if (vote := pattern[rule]) is not None:
                    (good, bad) = seen[rule]
                    good[0] += n * p * vote
                    good[1] += n * p
                    bad[0] += n * (1 - p) * (1 - vote)
                    bad[1] += n * (1 - p)
        on_good = {r: min(max(g[0] / g[1], 0.5 + EDGE), BOUNDS[1]) for r, (g, _) in seen.items()}
        on_bad = {r: min(max(b[0] / b[1], BOUNDS[0], 1 + EDGE - on_good[r]), BOUNDS[1]) for r, (_, b) in seen.items()}
        model = Model(goods / (total + 2), on_good, on_bad)
    return model


def _rows(docs: DataFrame, text_col: str) -> DataFrame:
    return docs.select(F.struct("*").alias("row"), F.col(text_col).alias("text"))


def assess(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None) -> DataFrame:
    """Counts, votes and verdict for every document.

    Returns the id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed (under 10 words, or over a
    fifth of them in repeated 5-word windows), p_good, votes and kept (not base_failed and p_good >= ``KEEP``). ``model``
    defaults to one fitted on all rows. Windows are compared by 64-bit hash within a text.

    Null and empty texts have no words and fail. Repeated rows come back repeated and count each time; rows without an
    id are judged like others. No rows give no rows. Other columns are ignored. Memory per task: one text's words.
    """
    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = stage(_voted(_measured(named.select(F.struct("id").alias("row"), "text"))), "votes")
    p = posterior(model or fit(found))
    kept = ~F.col("base_failed") & (p >= KEEP)
    columns = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return found.select(F.col("row.id").alias(id_col), *columns, p.alias("p_good"), "votes", kept.alias("kept"))


def keep_good(docs: DataFrame, text_col: str = "text", model: Model | None = None) -> DataFrame:
    """The documents that ``assess`` keeps, with all their columns; votes are taken twice rather than texts moved."""
    voted = _voted(_measured(_rows(docs, text_col)))
    p = posterior(model or fit(voted))
    return voted.where(~F.col("base_failed") & (p >= KEEP)).select("row.*")
