"""Personal data replaced by keyed surrogates of the same kind.

Detected: e-mail and IPv4 addresses, payment cards, bank accounts (IBAN), phone and social security numbers, keys and
passwords, and names after an honorific. A surrogate is a keyed hash of the normalised entity, drawn
in the entity's own format (digit for digit, letter for letter; checksums hold where they held; names keep gender, script
and capitals), so equal entities get equal surrogates in every document and spelling.

All entities of the corpus meet once, as rows of a table: two with one surrogate, or a surrogate that is itself an
entity, are redrawn with the next attempt until none is left. The few redrawn ones go to the rewriting tasks in parts
of at most ``PART_ROWS`` rows, one pass over the documents per part.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from propensia.session import stage

PART_ROWS = 200_000
MOST_ATTEMPTS = 64

MALE = "Mr Sir Herr Monsieur Señor господин Κύριος"
FEMALE = "Mrs Ms Miss Madam Frau Madame Mademoiselle Señora Señorita госпожа Κυρία"
NEUTRAL = "Dr Prof Mx"
HONORIFICS = {w: g for g, ws in (("m", MALE), ("f", FEMALE), ("n", NEUTRAL)) for w in ws.split()}
_CAPITAL = r"[A-ZÀ-ÖØ-ÞА-ЯЁΑ-Ω]"
_NAME = rf"{_CAPITAL}[^\W\d_]{{1,30}}(?:[-'’]{_CAPITAL}[^\W\d_]{{1,30}}){{0,2}}"
_SECRET = r"\b(?i:password|passwd|pwd|secret|token|api[_-]?key)\b\s{0,3}[=:]"
PATTERNS = {
    "secret": rf"(?P<secret_lead>{_SECRET}\s{{0,3}}[\"']?)(?P<secret>[A-Za-z0-9][A-Za-z0-9_+/~-]{{5,}}+)",
    "access_key": r"(?<![A-Za-z0-9])(?P<access_key>(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{20,}+|sk-[A-Za-z0-9]{16,}+)(?![A-Za-z0-9])",
    "email": r"(?<![\w.+-])(?P<email>[\w+-](?:[\w.+%-]{0,62}[\w+-])?@[\w-]{1,63}(?:\.[\w-]{1,63}){0,5}\.[^\W\d_]{2,24})",
    "ip": r"(?<![\d.])(?P<ip>(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d))(?!\.?\d)",
    "iban": r"\b(?P<iban>[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)\b",
    "phone": r"(?<![\w+])(?P<phone>\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\d)",
    "ssn": r"(?<![\d-])(?P<ssn>\d{3}-\d{2}-\d{4})(?![\d-])",
    "card": r"(?<![\d.-])(?P<card>\d(?:[ -]?\d){12,18})(?![\d-])",
    "name": rf"\b(?P<honorific>{'|'.join(sorted(HONORIFICS, key=len, reverse=True))})(?P<gap>\.?[  ])(?P<name>{_NAME}(?:[  ]{_NAME}){{0,2}})",
}
FINDER = re.compile("|".join(PATTERNS.values()))
#: every match of the patterns without an honorific holds one of these
HINT = re.compile(rf"[\d@]|AKIA|ASIA|gh[pousr]_|sk-|{_SECRET}")

_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_SYLLABLES = {
    "latin": (("b d f g k l m n p r s t v br dr tr st gr".split(), "a e i o u ei au".split()), "l n r s t nd rt ".split(" "), ("o", "a")),
    "cyrillic": (("б в г д к л м н п р с т бр др ст гр".split(), "а е и о у".split()), "в н р л ".split(" "), ("н", "а")),
    "greek": (("β γ δ κ λ μ ν π ρ σ τ φ χ".split(), "α ε ι ο ου".split()), "ν ρ ".split(" "), ("ος", "α")),
}


class Draw:
    """An endless keyed stream of choices for one entity and attempt."""

    def __init__(self, key: bytes, kind: str, canon: str, attempt: int):
        self.seed, self.key, self.n, self.pool = f"{kind}\0{attempt}\0{canon}".encode(), key, 0, 0

    def below(self, n: int) -> int:
        if self.pool < 1 << 64:
            block = hashlib.blake2b(self.seed + self.n.to_bytes(8, "little"), key=self.key, digest_size=64).digest()
            self.pool, self.n = int.from_bytes(block, "little") | 1 << 512, self.n + 1
        self.pool, out = divmod(self.pool, n)
        return out

    def like(self, text: str) -> str:
        """Digits for digits, letters for letters (hexadecimal stays so); the rest as it is."""
        hexadecimal = len(text) >= 8 and re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", text) is not None and not text.isdigit()
        out = []
        for c in text:
            if hexadecimal:
                d = "0123456789abcdef"[self.below(16)]
                out.append(d.upper() if text.isupper() else d)
            elif c.isdigit():
                out.append(str(self.below(10)))
            elif c.isalpha():
                x = _LETTERS[self.below(26)]
                out.append(x.upper() if c.isupper() else x)
            else:
                out.append(c)
        return "".join(out)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _iban_check(country: str, rest: str) -> str:
    number = int("".join(str(int(c, 36)) for c in rest + country + "00"))
    return f"{98 - number % 97:02d}"


def script(word: str) -> str:
    c = ord(word[0])
    return "cyrillic" if 0x400 <= c < 0x530 else "greek" if 0x370 <= c < 0x400 else "latin"


def surrogate(key: bytes, kind: str, canon: str, attempt: int = 0) -> str:
    """The normalised surrogate of a normalised entity; never the entity itself."""
    draw = Draw(key, kind, canon, attempt)
    for _ in range(100):
        out = _draw(draw, kind, canon)
        if out != canon:
            return out
    raise ValueError(f"no other {kind} of this format")


def _draw(draw: Draw, kind: str, canon: str) -> str:
    if kind == "email":
        name, _, domain = canon.partition("@")
        host, dot, top = domain.rpartition(".")
        return f"{draw.like(name)}@{draw.like(host)}{dot}{top}"
    if kind == "ip":
        return ".".join(str(1 + draw.below(254)) for _ in range(4))
    if kind == "access_key":
        lead = re.match(r"AKIA|ASIA|gh._|sk-", canon).group()
        return lead + draw.like(canon[len(lead) :])
    if kind == "card":
        out = canon[0] + draw.like(canon[1:])
        if luhn(canon):
            out = next(x for x in (out[:-1] + str(d) for d in range(10)) if luhn(x))
        return out
    if kind == "phone":
        keep = 0 if len(canon) == 10 else 2
        return canon[:keep] + str(2 + draw.below(8)) + draw.like(canon[keep + 1 :])
    if kind == "ssn":
        return f"{1 + draw.below(899):03d}{1 + draw.below(99):02d}{1 + draw.below(9999):04d}"
    if kind == "iban":
        rest = draw.like(canon[4:])
        held = _iban_check(canon[:2], canon[4:]) == canon[2:4]
        return canon[:2] + (_iban_check(canon[:2], rest) if held else draw.like(canon[2:4])) + rest
    if kind.startswith("name_"):
        (onsets, nuclei), codas, (male, female) = _SYLLABLES[script(canon)]
        out = "".join(onsets[draw.below(len(onsets))] + nuclei[draw.below(len(nuclei))] + codas[draw.below(len(codas))] for _ in range(2 + draw.below(2)))
        return out + onsets[draw.below(10)] + (female if kind.endswith("_f") else male)
    return draw.like(canon)


def _digits(text: str) -> str:
    return "".join(c for c in text if c.isdigit())


def _into(mention: str, new: str, test: Callable[[str], bool] = str.isalnum) -> str:
    """``mention`` with its characters that pass the test replaced in order."""
    fresh = iter(new)
    return "".join(next(fresh, c) if test(c) else c for c in mention)


def _cased(mention: str, new: str) -> str:
    if len(mention) > 1 and mention.isupper():
        return new.upper()
    return new[0].upper() + new[1:] if mention[0].isupper() else new


def parts(m: re.Match) -> Iterator[tuple[int, int, str, str, Callable[[str], str]]]:
    """(start, end, kind, normalised entity, how to write a surrogate here) of what a match holds."""
    kind = m.lastgroup
    start, end = m.span(kind)
    text = m.group(kind)
    if kind == "name":
        gender = HONORIFICS[m.group("honorific")]
        words = list(re.finditer(_NAME, text))
        for i, w in enumerate(words):
            # a family name is shared by both genders, save where its script inflects it
            last = i == len(words) - 1
            own = ("f" if gender == "f" else "m") if not last or script(w.group()) != "latin" else "n"
            yield start + w.start(), start + w.end(), f"name_{'last' if last else 'first'}_{own}", w.group().lower(), lambda s, w=w: _cased(w.group(), s)
    elif kind == "phone":
        digits = _digits(text)
        if text[0] == "+" and digits[0] == "1" and len(digits) == 11:
            yield start, end, kind, digits[1:], lambda s: _into(text, "1" + s, str.isdigit)
        else:
            yield start, end, kind, digits, lambda s: _into(text, s, str.isdigit)
    elif kind == "card":
        digits = _digits(text)
        if luhn(digits) or (len(digits) == 16 and digits[0] in "3456"):
            yield start, end, kind, digits, lambda s: _into(text, s, str.isdigit)
    elif kind == "ssn":
        yield start, end, kind, _digits(text), lambda s: _into(text, s, str.isdigit)
    elif kind == "iban":
        canon = text.replace(" ", "")
        if _iban_check(canon[:2], canon[4:]) == canon[2:4]:
            yield start, end, kind, canon, lambda s: _into(text, s)
    elif kind == "email":
        yield start, end, kind, text.lower(), lambda s: "".join(b.upper() if a.isupper() else b for a, b in zip(text, s))
    else:
        yield start, end, kind, text, lambda s: s


def mentions(text: str) -> Iterator[tuple[int, int, str, str, Callable[[str], str]]]:
    """All parts of a text that are replaced, in order."""
    if HINT.search(text) or any(h in text for h in HONORIFICS):
        for m in FINDER.finditer(text):
            yield from parts(m)


def _entities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = {(kind, canon) for t in batch.column(0) if t.is_valid for _, _, kind, canon, _ in mentions(t.as_py())}
        if found:
            kinds, canons = zip(*sorted(found))
            yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(canons)], ["kind", "canon"])


def _drawn(key: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*(batch.column(i).to_pylist() for i in range(3))))
            made = [surrogate(key, k, c, a) for k, c, a in rows]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())], ["kind", "canon", "attempt", "surrogate"])

    return run


def resolve(entities: DataFrame, key: bytes) -> DataFrame:
    """Kind, canon, attempt and surrogate: of one kind, no two surrogates are equal and none is an entity.

    ``entities`` has distinct rows of kind and canon. Of several that draw one surrogate the smallest keeps it.
    """
    shape = "kind string, canon string, attempt int, surrogate string"
    now = stage(entities.select("kind", "canon", F.lit(0).alias("attempt")).mapInArrow(_drawn(key), shape), "drawn")
    for _ in range(MOST_ATTEMPTS):
        first = now.groupBy("kind", "surrogate").agg(F.min("canon").alias("first"))
        taken = now.select("kind", F.col("canon").alias("surrogate"), F.lit(True).alias("taken"))
        claims = now.join(first, ["kind", "surrogate"]).join(taken, ["kind", "surrogate"], "left")
        claims = stage(claims.withColumn("lost", F.col("taken").isNotNull() | (F.col("canon") != F.col("first"))), "claims")
        if claims.where("lost").isEmpty():
            return now
        again = claims.where("lost").select("kind", "canon", F.col("attempt") + 1).mapInArrow(_drawn(key), shape)
        now = stage(claims.where("not lost").select("kind", "canon", "attempt", "surrogate").union(again), "drawn")
    raise RuntimeError(f"surrogates still collide after {MOST_ATTEMPTS} attempts: a format has too few values")


def _rewrite(key: bytes, redrawn: dict[tuple[str, str], str], part: int, of: int, text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, spans = batch.column("row"), batch.column("spans")
            out_spans = []
            for text, before in zip(rows.field(text_at), spans):
                found = list(before.as_py() or ())
                if text.is_valid:
                    for start, end, kind, canon, write in mentions(text.as_py()):
                        if of == 1 or int.from_bytes(hashlib.blake2b(f"{kind}\0{canon}".encode(), digest_size=8).digest(), "big") % of == part:
                            new = redrawn.get((kind, canon)) or surrogate(key, kind, canon)
                            found.append({"start": start, "end": end, "kind": kind, "value": write(new)})
                out_spans.append(sorted(found, key=lambda s: s["start"]))
            done = [_applied(t.as_py(), s) for t, s in zip(rows.field(text_at), out_spans)]
            yield pa.RecordBatch.from_arrays([rows, pa.array(out_spans, spans.type), pa.array(done, pa.string())], ["row", "spans", "new_text"])

    return run


def _applied(text: str | None, spans: list[dict]) -> str | None:
    if not spans:
        return text
    out, at = [], 0
    for s in spans:
        out += [text[at : s["start"]], s["value"]]
        at = s["end"]
    return "".join([*out, text[at:]])


def _part_of(of: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = zip(batch.column("kind").to_pylist(), batch.column("canon").to_pylist())
            part = [int.from_bytes(hashlib.blake2b(f"{k}\0{c}".encode(), digest_size=8).digest(), "big") % of for k, c in names]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part, pa.int32())], [*batch.schema.names, "part"])

    return run


SPAN = T.StructType().add("start", "long").add("end", "long").add("kind", "string").add("value", "string")


def _replaced(docs: DataFrame, key: bytes, text_col: str) -> DataFrame:
    """Rows (row, spans, new_text); row holds the columns of ``docs``."""
    found = docs.select(F.col(text_col)).mapInArrow(_entities, "kind string, canon string").distinct()
    redrawn = stage(resolve(stage(found, "entities"), key).where("attempt > 0").select("kind", "canon", "surrogate"), "redrawn")
    of = max(1, -(-redrawn.count() // PART_ROWS))
    if of > 1:
        redrawn = stage(redrawn.mapInArrow(_part_of(of), "kind string, canon string, surrogate string, part int"), "redrawn")
    rows = docs.select(F.struct("*").alias("row"), F.lit(None).cast(T.ArrayType(SPAN)).alias("spans"))
    shape = T.StructType(rows.schema.fields).add("new_text", "string")
    at = docs.columns.index(text_col)
    for part in range(of):
        mine = redrawn if of == 1 else redrawn.where(F.col("part") == part)
        sent = docs.sparkSession.sparkContext.broadcast({(r["kind"], r["canon"]): r["surrogate"] for r in mine.collect()})
        rows = rows.select("row", "spans").mapInArrow(lambda b, sent=sent, part=part: _rewrite(key, sent.value, part, of, at)(b), shape)
        if part < of - 1:
            rows = stage(rows, "rewritten")
    return rows


def replace_private(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts with surrogates in place of personal data.

    Returns the id, text, n_replaced and spans (start and end in characters of the given text, kind, value).
    ``key`` fixes all surrogates: the same key gives the same ones in any run, save redrawn ones, which depend on the
    corpus. Only what the patterns find is replaced; all other characters stay.

    A null text stays null, an empty one empty. Repeated rows come back repeated and alike. Rows without an id are
    handled like others. No rows give no rows. Other columns are ignored. Memory per task: one batch of texts and one part of
    the redrawn entities.
    """
    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = _replaced(named, key, "text")
    return found.select(F.col("row.id").alias(id_col), F.col("new_text").alias("text"), F.coalesce(F.size("spans"), F.lit(0)).cast("long").alias("n_replaced"), "spans")


def with_surrogates(docs: DataFrame, key: bytes, text_col: str = "text") -> DataFrame:
    """``docs`` with the text column replaced; all other columns as they are."""
    found = _replaced(docs, key, text_col)
    return found.select(*[F.col("new_text").alias(c) if c == text_col else F.col(f"row.`{c}`") for c in docs.columns])
