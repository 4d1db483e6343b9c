"""Packing, source divergence and phrases against brute force, and odd inputs."""
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from netstate.llm import divergence, packing, phrases, plans

SCHEMA = "doc_id bigint, text string, lang string, source string, rank string, chunk string, n string, salt int"
WORDS = "the of and to in for on with that this are was from by at as it be an or".split()


def rows_of(spark, rows):
    """(doc_id, text, lang, source) with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, "x", "y", "z", 7) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def corpus():
    draw = random.Random(5)
    rows = []
    for i in range(160):
        text = " ".join(draw.choices(WORDS, weights=range(20, 0, -1), k=draw.randint(0, 120)))
        text = re.sub(r" (that|it) ", lambda m: draw.choice([". ", ", ", "\n", " "]) + m[1].title() + " ", text)
        rows.append((i, text, draw.choice(["en", "en", "fr", None]), draw.choice(["a", "b", "c", "ä", None])))
    rows += [(200, None, "en", "a"), (201, "", "xx", "only"), (202, "??? 12 3", "xx", "b"), (None, rows[0][1], "en", "a"),
             (200, rows[1][1], "en", "z"), (203, "the of " * 3000, "en", "b"), (204, "ünïcödé 日本 <|endoftext|> x\x00y", "fr", "a")]
    return rows


# --- packing -----------------------------------------------------------------------------------------------------------

def check_packed(got, rows, capacity=1024):
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(plans.vocabulary())
    want = Counter()
    for doc, text, *_ in rows:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [2], dtype="<u4")
        edge = len(ids) % capacity or capacity
        cuts = [0, *range(edge, len(ids) + 1, capacity)]
        want.update((doc, i, a, b - a, zlib.crc32(ids[a:b].tobytes())) for i, (a, b) in enumerate(zip(cuts, cuts[1:])))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    filled = defaultdict(list)
    for r in got:
        filled[r.sequence_id].append((r.offset, r.length))
    for spans in filled.values():                                   # gapless from 0, within the capacity
        end = 0
        for offset, length in sorted(spans):
            assert offset == end
            end += length
        assert end <= capacity
    return len(filled)


def test_packing_holds_every_piece_once(spark, corpus):
    got = packing.packing_digest(rows_of(spark, corpus), plans.vocabulary()).collect()
    n = check_packed(got, corpus)
    total = sum(r.length for r in got)
    assert n <= -(-total // 1024) + 1


def test_packing_of_small_sequences_and_ids(spark, corpus):
    table = packing.materialize(packing.pieces(rows_of(spark, corpus[:40]), plans.vocabulary(), 16, None, with_ids=True), "pieces")
    packed = packing.pack(table, 16)
    rows = packed.collect()
    assert max(r.offset + r.length for r in rows) <= 16 and all(len(r.ids) == r.length for r in rows)
    whole = {r.sequence_id: r for r in packing.sequences(packed).collect()}
    for r in rows:
        s = whole[r.sequence_id]
        assert s.ids[r.offset:r.offset + r.length] == r.ids and r.offset in s.offsets


def test_configurations_hold_the_histogram():
    draw = np.random.default_rng(1)
    short = np.where(np.arange(257) < 120, 50, 3)                   # many short pieces: nothing forbids full sequences
    for capacity, need in ((16, draw.integers(0, 9, 17)), (64, draw.integers(0, 200, 65)), (256, short), (64, np.zeros(65, int))):
        need[0] = 0
        plan = packing.configurations(need, capacity)
        held = np.zeros_like(need)
        for copies, config in plan:
            assert copies > 0 and sum(n * k for n, k in config) <= capacity
            for n, k in config:
                held[n] += copies * k
        assert np.array_equal(held, need)
        bound = -(-int((need * np.arange(capacity + 1)).sum()) // capacity)
        plain = sum(c for c, _ in packing.best_fit(need, [], capacity))
        assert bound <= sum(c for c, _ in plan) <= (bound + 2 if need is short else plain)


def test_knapsack_against_enumeration():
    import itertools
    draw = np.random.default_rng(2)
    for _ in range(30):
        price, limit = draw.random(9), draw.integers(0, 3, 9)
        limit[0] = 0
        best = max(sum(k * price[n] for n, k in enumerate(ks)) for ks in itertools.product(*(range(x + 1) for x in limit))
                   if sum(n * k for n, k in enumerate(ks)) <= 8)
        got = packing.knapsack(price, limit, 8)
        assert all(k <= limit[n] for n, k in got.items()) and sum(n * k for n, k in got.items()) <= 8
        assert sum(k * price[n] for n, k in got.items()) == pytest.approx(best)


@pytest.mark.parametrize("ranked", [True, False])
def test_tokens_are_those_of_the_library(monkeypatch, ranked):
    """By ranks and, in short segments, the plain way."""
    from tokenizers import Tokenizer
    monkeypatch.setattr(packing, "SEGMENT", 50)
    with open(plans.vocabulary(), encoding="utf-8") as f:
        mine = packing.Tokens(f.read())
    assert mine.ranked is not None
    if not ranked:
        mine.ranked = None
    plain = Tokenizer.from_file(plans.vocabulary())
    draw = random.Random(1)
    alphabet = [" ", "  ", "\n", "a", "the", "'s", "é", "日本", "\u00a0", "\x1c", "12", "...", "<|endoftext|>", "\t", "\x85", "—", "Ж"]
    texts = ["".join(draw.choices(alphabet, k=draw.randint(0, 120))) for _ in range(300)]
    texts += ["", " " * 300_000 + "x", "a" * 30_000]
    texts += [f"a{c}b {c}c {c}{c}1{c} {c}" for c in map(chr, [*range(0x250), *range(0x400, 0x482), *range(0x2010, 0x2028), 0x20ac,
                                                          *range(0x4e00, 0x9fa6, 37)])]
    for text in texts:
        assert mine.ids(text).tolist() == plain.encode(text, add_special_tokens=False).ids, text[:40]


def test_packing_of_an_empty_table(spark):
    assert packing.packing_digest(rows_of(spark, []), plans.vocabulary()).count() == 0


# --- divergence --------------------------------------------------------------------------------------------------------

def brute_divergence(rows, least=10, top=10):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        words = term.findall((text or "").translate(lower))
        counts[lang, source].update(words)
        docs[lang].update(set(words))
        groups.add((lang, source))
    out = []
    for lang, source in groups:
        kept = [t for t, n in docs[lang].items() if n >= least]
        others = [s for k, s in groups if k == lang]
        whole = Counter()
        for s in others:
            whole.update(counts[lang, s])

        def p(c):
            space = sum(c[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 10 ** 9 * (c[t] + 2) // space for t in kept}

        def f(x, y):
            return (x - y) ** 2 // (x + y)

        mine, q = p(counts[lang, source]), p(whole)
        pairs = []
        for s in others:
            if s != source:
                theirs = p(counts[lang, s])
                pairs.append((s, sum(f(mine[t], theirs[t]) for t in kept)))
        terms = [(t, f(mine[t], q[t])) for t in kept if counts[lang, source][t] > 0 and mine[t] > q[t]]
        for part, items, most in (("pair", pairs, None), ("term", terms, top)):
            items.sort(key=lambda x: (-x[1], x[0].encode()))
            out += [(lang, source, part, t, v, i + 1) for i, (t, v) in enumerate(items[:most])]
    return sorted(out)


@pytest.mark.parametrize("cells, tile", [(1 << 18, 256), (40, 2)])
def test_divergence_against_brute_force(spark, corpus, monkeypatch, cells, tile):
    """Also with many blocks and with tiles of sources."""
    monkeypatch.setattr(divergence, "CELLS", cells)
    monkeypatch.setattr(divergence, "TILE", tile)
    got = divergence.divergence(rows_of(spark, corpus))
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == brute_divergence(corpus)


def test_run_lengths_spell_the_counts(spark, corpus):
    terms = divergence.kept_terms(rows_of(spark, corpus)).cache()
    runs = divergence.run_lengths(terms, 3).collect()
    total = Counter()
    for r in runs:
        assert r.starts[0] == 0 and r.starts == sorted(set(r.starts)) and r.starts[-1] < r.n_terms
        assert all(a != b for a, b in zip(r.counts, r.counts[1:]))
        for n, a, b in zip(r.counts, r.starts, [*r.starts[1:], r.n_terms]):
            total[r.lang, r.source] += n * (b - a)
    want = Counter()
    for r in terms.collect():
        for c in r.cells:
            want[r.lang, c.source] += c.n
    assert total == want


def test_scaled_is_exact():
    for count, total in ((0, 2), (10 ** 12, 9 * 10 ** 15), (7, 10 ** 10 + 3), (9 * 10 ** 15 - 5, 9 * 10 ** 15)):
        assert divergence.scaled(np.array([count]), total)[0] == 1 + 10 ** 9 * (count + 2) // total


def test_divergence_of_odd_tables(spark):
    assert divergence.divergence(rows_of(spark, [])).count() == 0
    rows = [(1, None, None, None), (2, "a", None, "s"), (3, "", "", "s")]
    assert sorted(map(tuple, divergence.divergence(rows_of(spark, rows)).collect())) == brute_divergence(rows)


# --- phrases -----------------------------------------------------------------------------------------------------------

def brute_phrases(rows, least=10, covered=50, top=2000):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f, n = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in (1, 2, 3):
                f[lang].update(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        scored = []
        triples = [p for p, a in counts.items() if len(p) == 3 and a >= least]
        for p, a in counts.items():
            if len(p) < 2 or a < least:
                continue
            if len(p) == 2 and any(100 * counts[t] >= covered * a for t in triples if p in (t[:2], t[1:])):
                continue
            score, _, left, right = min((10 ** 6 * a * a // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]])
                                        for k in range(1, len(p)))
            scored.append((" ".join(p), a, left, right, score))
        scored.sort(key=lambda x: (-x[4], -x[1], x[0].encode()))
        out += [(lang, i + 1, phrase, a, left, right, n[lang], score)
                for i, (phrase, a, left, right, score) in enumerate(scored[:top])]
    return sorted(out)


@pytest.mark.parametrize("budget", [1 << 20, 4000, 200, 8])
def test_phrases_against_brute_force(spark, corpus, monkeypatch, budget):
    """From one group to prefixes cut at every depth, and with a flush after every few texts."""
    if budget < 1000:
        monkeypatch.setattr(phrases, "FLUSH_TOKENS", 300)
        monkeypatch.setattr(phrases, "FLUSH_WORDS", 30)
    got = phrases.collocations(rows_of(spark, corpus), budget=budget)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == brute_phrases(corpus)


def test_phrases_keep_to_the_first_ranks(spark, corpus):
    got = phrases.collocations(rows_of(spark, corpus), top=7, least=3)
    assert sorted(map(tuple, got.collect())) == brute_phrases(corpus, least=3, top=7)


def test_phrases_of_odd_tables(spark):
    assert phrases.collocations(rows_of(spark, [])).count() == 0
    rows = [(None, "A b\tC. a  b c\x0bd " * 12, None, None), (1, None, None, None), (2, " \t.", "en", "s")]
    assert sorted(map(tuple, phrases.collocations(rows_of(spark, rows)).collect())) == brute_phrases(rows)


def test_bits_never_miss(spark):
    words = [("en", f"w{i}", i) for i in range(300)] + [("日", "é", 1)]
    bits = phrases.Bits(spark.createDataFrame(words, "lang string, word string, n bigint"), len(words))
    hashes = np.array([phrases.word_hash(a.encode(), w.encode()) for a, w, _ in words], dtype=np.uint64)
    assert bits.holds(hashes).all()
    other = np.array([phrases.word_hash(b"en", f"x{i}".encode()) for i in range(2000)], dtype=np.uint64)
    assert bits.holds(other).mean() < 0.2
