"""Licence scans against a look-up of every template at every place."""

import random
import re

import numpy as np
import pytest
from llm_texts import prose
from propensia.llm import license_scan

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def by_hand(rows, notices):
    found = set()
    for i, text in rows:
        w = split(text)
        for name, notice in notices.items():
            t = split(notice)
            k = min(5, len(t))
            wanted = {tuple(t[j : j + k]) for j in range(len(t) - k + 1)}
            places = [(j, tuple(w[j : j + k])) for j in range(len(w) - k + 1) if tuple(w[j : j + k]) in wanted]
            most = (0, 0)
            for j, _ in places:
                n = len({g for q, g in places if j <= q < j + 2 * len(t) - k + 1})
                most = max(most, (n, -j))
            if most[0] >= 0.75 * len(wanted):
                found.add((i, name, most[0] / len(wanted), -most[1]))
    return found


def edited(rng, text, share):
    """The text with some words lost, changed or added."""
    out = []
    for word in text.split():
        draw = rng.random()
        out += [] if draw < share / 3 else ["other"] if draw < share * 2 / 3 else [word, "more"] if draw < share else [word]
    return " ".join(out)


@pytest.fixture(scope="module")
def planted():
    rng = random.Random(3)
    names = sorted(license_scan.NOTICES)
    rows = [(None, None), (0, None), (1, ""), (2, " \n"), (3, "mit"), (4, "word " * 30_000 + license_scan.NOTICES["mit-text"])]
    for i in range(5, 700):
        notice = license_scan.NOTICES[rng.choice(names)]
        rows.append((i, " ".join([prose(rng, rng.randrange(1, 260)), edited(rng, notice, rng.choice([0, 0.02, 0.06, 0.1])), prose(rng, rng.randrange(1, 90))])))
    return rows + rows[:9] + rows[100:110]  # repeated rows


def test_finds_what_a_look_up_finds(make, planted):
    got = [(r.doc_id, r.license, r.containment, r.start_word) for r in license_scan.scan(make(planted)).collect()]
    want = by_hand(planted, license_scan.NOTICES)
    assert set(got) == want and len(want) > 500
    assert len(got) == sum((i, name) == (w[0], w[1]) for i, _ in planted for w in want for name in [w[1]])


def test_bands_reach_their_recall():
    """Windows that hold the least allowed share of a template, by the bands' own hash functions."""
    rng = np.random.default_rng(5)
    wanted = license_scan.templates(license_scan.NOTICES)
    groups, factors, shifts = license_scan.windows_of(wanted)
    assert {n for w in groups for n in w.bands[0].owners} == {n for n, t in enumerate(wanted) if len(t.shingles) > license_scan.SHORT}
    for w in groups:
        for n in w.bands[0].owners:
            held = -(-3 * len(wanted[n].shingles) // 4)
            for _ in range(200):
                others = rng.integers(0, 2**64, license_scan.SECTIONS * w.stride - held, dtype=np.uint64)
                window = np.concatenate([others, rng.permutation(wanted[n].shingles)[:held]])
                assert any(n in b.find(np.array([(window * factors[h] + shifts[h]).min()]))[1] for h, b in enumerate(w.bands))


@pytest.mark.parametrize("stride", [1, 3, 8])
def test_windows_hold_every_stretch_and_end_with_their_row(stride):
    rng = np.random.default_rng(stride)
    count = np.array([0, 5, -2, 1, 40, 17])
    base = np.cumsum([1, *(np.maximum(count, 0) + 5)])[:-1]
    hashes = rng.permutation(int(base[-1] + count[-1] + 4)).astype(np.uint64)
    s = license_scan.sections(base, count, stride)
    want = [hashes[b + j : b + min(c, j + 3 * stride)].min() for b, c in zip(base, count) for j in range(0, max(c, 0), stride)]
    assert s.minima(hashes).tolist() == want
    assert license_scan.bands_needed(20, 16) > license_scan.bands_needed(16, 16)


def test_no_templates_and_templates_without_words(make):
    rows = [(1, "a b c d e f"), (None, None)]
    assert license_scan.scan(make(rows), {}).collect() == []
    assert license_scan.scan(make(rows), {"none": "", "dots": "..."}).collect() == []
    assert [r.license for r in license_scan.scan(make(rows), {"two": "C D", "none": ""}).collect()] == ["two"]
