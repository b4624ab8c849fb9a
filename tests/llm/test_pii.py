"""Personal data against the plain patterns and counts, on whole and odd texts."""

import hashlib
import math
import re
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from dotforge.llm import pii

SCHEMA = "doc_id long, text string, digest string, base string, entity string, spans string, term long, near string, n long"


def base(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 12 <= len(d) <= 19 and sum(d[0::2] + [sum(divmod(2 * x, 10)) for x in d[1::2]]) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def plain(texts):
    """(base spans, all spans) of each text, and whether each added one is generalised."""
    low = [(t or "").translate({c: c + 32 for c in range(65, 91)}) for t in texts]
    words = [[(m.start(), m.end()) for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)] for t in low]
    found = [base(t or "") for t in texts]
    n, n_c, n_t = len(texts), defaultdict(set), defaultdict(set)
    both, windows, mentions = defaultdict(set), defaultdict(set), []
    for i, t in enumerate(low):
        for s, e in words[i]:
            n_t["t", t[s:e]].add(i)
            n_t["g", t[s : min(e, s + 3)]].add(i)
        free = [(s, e) for s, e in words[i] if all(e <= a or s >= b for a, _, b in found[i])]
        for a, k, b in found[i]:
            raw = texts[i][a:b]
            c = (k, raw.lower() if k == 0 else raw if k == 1 else re.sub(r"[^0-9]", "", raw))
            near = [x for x in free if x[1] <= a][-10:] + [x for x in free if x[0] >= b][:10]
            window = tuple(t[s:e] for s, e in near)
            n_c[c].add(i)
            for s, e in near:
                for key in (("t", t[s:e]), ("g", t[s : min(e, s + 3)])):
                    both[c, key].add(i)
                    windows[c, key].add(window)
            mentions.append((i, c, near))

    def tells(c, key):
        known = math.log2(n / len(n_c[c]))
        return known > 0 and len(windows[c, key]) >= pii.WINDOWS and math.log2(n * len(both[c, key]) / (len(n_c[c]) * len(n_t[key]))) >= pii.ALPHA * known

    added = defaultdict(lambda: True)
    for i, c, near in mentions:
        for s, e in near:
            if tells(c, ("t", low[i][s:e])):
                added[i, s, e] &= not tells(c, ("g", low[i][s : min(e, s + 3)]))
    every = [sorted(found[i] + [(s, 4, e) for j, s, e in added if j == i]) for i in range(n)]
    return found, every, dict(added)


def told(spans):
    return ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in spans)


def frame(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, "d", "b", "e", "s", 1, "n", 2) for i, t in zip(ids or range(len(texts)), texts)], SCHEMA).repartition(6)


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(6)
    words = [f"{a}{b}" for a in "bdfgklmnprst" for b in ("Ran", "tisol", "éod", "mek", "a", "日本語")] + ["trisol", "trimek"]
    prose = lambda n: " ".join(rng.choice(words, n))
    out = [prose(60) for _ in range(80)]
    for n in range(6):  # names that go with one address, one of them with a beginning that many terms share
        out.append(f"{prose(20)} zaphod zarniwoop {prose(3)} zap@mail.example.com {prose(4)} Zaphod {prose(20)}")
        out.append(f"{prose(9)} zarniwoop {prose(30)}")
        out.append(f"{prose(5)} +1 (499) 555-6503 quux{n} {prose(3)} Board@Example.org {prose(6)} trillian {prose(8)}")
        out.append(f"{prose(5)} board@example.ORG and {prose(3)} trillian, 4111 1111-1111 1111 {prose(15)} trimek")
    out += [out[80]] * 40 + [None, "", " ", "1.2.3.4.5.6.7.8.9 999.1.1.1 001.002.3.4", "a@b a@b.c@d.e.f @x.y ..@-.-", "+1 +12 +123456789012 + 1", "5" * 18 + " " + "0" * 13]
    return out


def test_spans_equal_plain_patterns_and_counts(spark, texts):
    found, every, added = plain(texts)
    assert sum(added.values()) and not all(added.values())  # some are generalised, others removed
    got = {r.doc_id: r for r in pii.report(frame(spark, texts)).collect()}
    assert len(got) == len(texts)
    for i in range(len(texts)):
        assert got[i].spans == told(every[i]), texts[i]
        assert got[i].base_sha256 == hashlib.sha256(told(found[i]).encode()).hexdigest()
        assert [got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone] == [sum(k == n for _, k, _ in found[i]) for n in range(4)]
        assert found[i] or not every[i]  # a text without personal data is left alone
    clean = {r.doc_id: r.text for r in pii.sanitise(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        want, at = "", 0
        for s, k, e in every[i]:
            if e > at:
                s = max(s, at)
                want += t[at:s] + (f"[{pii.KINDS[k].upper()}]" if k < 4 else t[s : s + 3] + "*" if added[i, s, e] else "*")
                at = e
        assert clean[i] == (None if t is None else want + t[at:])


def test_texts_of_one_character_end_in_time(spark):
    out = ["a" * 400_000, "1" * 400_000, "1." * 200_000, "a@" * 200_000, "+1" + " " * 400_000, "1 " * 200_000, "." * 400_000 + "@", "1.1.1." * 70_000]
    got = {r.doc_id: r for r in pii.report(frame(spark, out)).collect()}
    assert [got[i].n_ip for i in range(len(out))] == [0, 0, 50_000, 0, 0, 0, 0, 52_500] and got[3].n_email == 0


def test_odd_rows(spark):
    rows = pii.report(frame(spark, ["x +1 499 555 6503", "x +1 499 555 6503", None, None], [None, None, 7, 7])).collect()
    assert sorted((r.n_phone, r.spans) for r in rows) == [(0, ""), (0, ""), (1, "phone:2:17"), (1, "phone:2:17")]
    empty = frame(spark, ["x"]).limit(0)
    assert pii.report(empty).collect() == [] and pii.sanitise(empty).columns == SCHEMA.replace(",", "").split()[::2]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a1@.+-() é%9", max_size=40))
def test_patterns_are_the_plain_ones(t):
    place = {len(t[:i].encode()): i for i in range(len(t) + 1)}
    assert [(place[s], k, place[e]) for s, k, e in pii.patterns(t.encode())] == base(t)
