"""Alignment, Jaccard join and lexical search against brute force, with odd texts, hot families, ties and repeats."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from llm.test_operators import SCHEMA, docs, empty, rows, words  # noqa: F401
from millwright.llm import align, jaccard, lexical

ITEMS = "item_id long, text string, doc_id long, score string"


# --- alignment


class Whole:
    """Both tokenizers on whole texts, and their tokens' bytes by the published table of byte-level BPE."""

    def __init__(self):
        import public_tokenizers
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(public_tokenizers.path(align.BYTE_BPE))
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=public_tokenizers.path(align.PIECE_BPE))
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = [b for b in range(256) if b not in plain]
        self.byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}

    def piece(self, i):
        p = self.b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()

    def __call__(self, text):
        """Ids, groups as text and links, or nothing."""
        raw = (" " + (text or "")).encode()
        a, b = self.a.encode(" " + (text or ""), add_special_tokens=False).ids, self.b.encode(text or "")
        ab, bb = [bytes(self.byte[c] for c in self.a.id_to_token(i)) for i in a], [self.piece(i) for i in b]
        if not text or b"".join(ab) != raw or b"".join(bb) != raw:
            return None
        ends_a, ends_b = np.cumsum([*map(len, ab)]).tolist(), np.cumsum([*map(len, bb)]).tolist()
        of = lambda ends: {at: i for i, e in enumerate(ends) for at in range(ends[i - 1] if i else 0, e)}
        in_a, in_b = of(ends_a), of(ends_b)
        links = [(a[i], b[j]) for i, j in dict.fromkeys((in_a[x], in_b[x]) for x in range(len(raw)))]
        cuts = sorted({*ends_a} & {*ends_b})
        groups = []
        for lo, hi in zip([0, *cuts], cuts):
            groups.append("|".join(",".join(str(ids[k]) for k in dict.fromkeys(where[x] for x in range(lo, hi))) for ids, where in ((a, in_a), (b, in_b))))
        return len(a), len(b), groups, links


def brute_alignment(rows):
    whole = Whole()
    found = [(r["doc_id"], whole(r["text"])) for r in rows]
    counts = Counter(x for _, f in found if f for x in f[3])
    top = defaultdict(int)
    for (_, b), n in counts.items():
        top[b] = max(top[b], n)
    out = Counter()
    for doc, f in found:
        if f is None:
            out[doc, 0, 0, 0, 0, 0, 0, ""] += 1
        else:
            n_a, n_b, groups, links = f
            out[doc, n_a, n_b, len(groups), len(links), sum(counts[x] == top[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(";".join(groups).encode()).hexdigest()] += 1
    return out


ODD = ["a  b", "x\n y", "▁a b", "<|endoftext|> hi <s>", "é ﬁ 日本語 \U0001f600 ok", "a  b c", "tab\t b", "a\x0b b", "end ", "  lead", "\x00 z", "　 k  l", "can't 'll x's", "a\x1c b c", "﻿ x ​ y", "ÿþ à ߿ ￿", "unbelievablyunbrokenword" * 50]


@pytest.mark.parametrize("head", [align.HEAD, 200, 0])
def test_alignment(spark, docs, rows, head):  # noqa: F811
    cols = "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256".split()
    few = [r for r in rows if len(r["text"] or "") < 20_000]
    odd = spark.createDataFrame([(20_000 + i, t) for i, t in enumerate(ODD)], "doc_id long, text string")
    both = docs.where("text is null or length(text) < 20000").select("doc_id", "text").unionByName(odd)
    got = Counter(tuple(r) for r in align.align_documents(both, head=head).select(*cols).collect())
    assert got == brute_alignment([*few, *({"doc_id": 20_000 + i, "text": t} for i, t in enumerate(ODD))])


def test_alignment_of_a_long_text_and_of_none(docs, empty):  # noqa: F811
    long = align.align_documents(docs.where("doc_id = 9008")).collect()[0]
    assert long["n_a"] == 30_001 and long["n_groups"] == 30_001 and long["n_links"] == 30_001
    assert align.align_documents(empty).count() == 0


@pytest.mark.parametrize("seed", range(40))
def test_diagonal_runs(seed):
    rng = random.Random(seed)
    n = rng.choice([1, 5, 400])
    both = sorted(rng.sample(range(1, 10 * n), n))
    a, b = (np.array(sorted({x for x in both if rng.random() < rng.choice([1, 0.9, 0.5])} | {10 * n})) for _ in range(2))
    first_a, first_b, link_a, link_b = align.align(a, b)
    cuts = sorted({*a.tolist()} & {*b.tolist()})
    assert first_a.tolist() == [0, *(np.searchsorted(a, cuts[:-1]) + 1)] and first_b.tolist() == [0, *(np.searchsorted(b, cuts[:-1]) + 1)]
    starts_a, starts_b = np.append(0, a[:-1]), np.append(0, b[:-1])
    want = [(i, j) for i in range(len(a)) for j in range(len(b)) if max(starts_a[i], starts_b[j]) < min(a[i], b[j])]
    assert sorted(zip(link_a.tolist(), link_b.tolist())) == want


def test_uncut_tokenizers_agree():
    """A side that must see whole texts gives the same ids."""
    import pyarrow as pa
    from millwright.llm.tokenbin import tokenizer_path

    cut, uncut = (align.Encoder(tokenizer_path(align.BYTE_BPE), tokenizer_path(align.PIECE_BPE)) for _ in range(2))
    assert cut.cuts
    uncut.cuts = False
    texts = pa.array([t for t in ODD if t] + ["plain words, here. And more"])
    for x, y in zip(cut(texts), uncut(texts)):
        assert (x == y).all()


# --- Jaccard join


def shingles(text, width=jaccard.WIDTH):
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in words(text)]
    return {" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def brute_jaccard(rows, percent=jaccard.PERCENT):
    sets = [frozenset(shingles(r["text"])) for r in rows]
    place = defaultdict(list)
    for i, s in enumerate(sets):
        place[s].append(i)
    distinct = [s for s in place if s]
    top = {s: s for s in distinct}

    def root(s):
        while top[s] is not s:
            s = top[s]
        return s

    by = sorted(distinct, key=len)
    for i, x in enumerate(by):
        for y in by[:i]:
            if 100 * len(y) >= percent * len(x) and 100 * len(x & y) >= percent * len(x | y):
                top[root(x)] = root(y)
    ids = defaultdict(list)
    for s in distinct:
        ids[root(s)] += [rows[i]["doc_id"] for i in place[s]]
    low = {k: min((d for d in v if d is not None), default=None) for k, v in ids.items()}
    return Counter((r["doc_id"], len(s), low[root(s)] if s else r["doc_id"]) for r, s in zip(rows, sets))


def jaccard_rows(found):
    return Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found.collect())


@pytest.fixture(scope="module")
def family(spark):
    """Families of near copies, some in one component and some in many, edges of the bound, and sets that share all frequent shingles."""
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(3000)]
    base = [rng.choice(vocabulary) for _ in range(120)]
    out = []
    for k in range(150):  # a chain through the bound: one word more changed every time
        text = base[:]
        for p in rng.sample(range(120), rng.choice([1, 1, 2, 3, 5])):
            text[p] = rng.choice(vocabulary)
        out.append(" ".join(text))
    lines = [" ".join(rng.choice(vocabulary) for _ in range(12)) for _ in range(12)]
    out += ["\n".join(rng.sample(lines, 8)) for _ in range(120)]  # all shingles but those of the seams are frequent
    for n in range(1, 24):
        out += [" ".join(base[:n]), " ".join(base[:n]).upper(), " ".join(base[: n + 1])]
    out += [" ".join(base)] * 5 + [" ".join([*base, *base])]
    return spark.createDataFrame([(i, t) for i, t in enumerate(out)], "doc_id long, text string").repartition(5)


@pytest.mark.parametrize("limit", [jaccard.LIST_LIMIT, 3, 10_000])
def test_jaccard_of_families(family, limit):
    want = brute_jaccard(family.collect())
    assert max(Counter(c for _, _, c in want.elements()).values()) > 90
    assert jaccard_rows(jaccard.jaccard_groups(family, list_limit=limit)) == want


def test_jaccard_of_documents(docs, rows, empty):  # noqa: F811
    assert jaccard_rows(jaccard.jaccard_groups(docs)) == brute_jaccard(rows)
    assert jaccard.jaccard_groups(empty).count() == 0


@pytest.mark.parametrize("percent", [60, 80])
def test_jaccard_at_other_bounds(family, percent):
    few = family.where("doc_id % 4 = 0")
    assert jaccard_rows(jaccard.jaccard_groups(few, percent=percent, list_limit=8)) == brute_jaccard(few.collect(), percent)


def test_merge_and_probe():
    """The heap merge gives the candidates that are often enough in the lists; the probe equals the intersection."""
    lists = [[(9, 1), (10, 2), (10, 5)], [(9, 1), (10, 2)], [(10, 2), (10, 4), (12, 9)]]
    assert jaccard.merge_lists(lists, 10, 5, 90) == [1, 2]
    rng = np.random.default_rng(5)
    for _ in range(200):
        pool = rng.integers(0, 1 << 62, 130, dtype=np.uint64)
        q, c = (np.unique(rng.choice(pool, rng.integers(9, 125), replace=False)) for _ in range(2))
        both = len(np.intersect1d(q, c))
        assert jaccard.probe(rng.permutation(q), c, 90) == (100 * both >= 90 * (len(q) + len(c) - both))


def test_shingle_levels(spark):
    counts = spark.createDataFrame([(5, 4), (5, 5), (7, 2), (8, 1), (5 + (1 << 10), 100)], "shingle long, count long")
    levels = jaccard.shingle_levels(counts, slots=1 << 10)
    assert levels[5] == 6 and levels[7] == 1 and levels[8] == 0
    assert jaccard.shingle_levels(counts, heavy=1, slots=1 << 10)[5] == 6 and not jaccard.shingle_levels(counts, heavy=1, slots=1 << 10)[7]


# --- lexical search


def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in re.findall(lexical.TERM, text or "")]


def brute_ranks(rows, items, top=lexical.TOP):
    each = [(r["doc_id"], Counter(terms(r["text"]))) for r in rows]
    each = [(d, c, sum(c.values())) for d, c in each if c]
    n, total = len(each), sum(x[2] for x in each)
    df = Counter(t for _, c, _ in each for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * k + 1))) for t, k in df.items()}
    out = Counter()
    for item in items:
        scores = []
        for doc, c, length in each:
            m = 25 + 75 * length * n // total
            s = sum(weight[t] * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(item["text"]) if t in c)
            if s > 0:
                scores.append((-s, doc is None, doc or 0))
        for rank, (s, null, doc) in enumerate(sorted(scores)[:top], 1):
            out[item["item_id"], rank, None if null else doc, -s] += 1
    return out


@pytest.fixture(scope="module")
def items(spark, rows):  # noqa: F811
    asked = [(r["item_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    asked += [(500, None), (501, ""), (502, "... --"), (503, "no-such-term-anywhere-zzz"), (504, "word WORD end"), (None, "same text here"), (504, "word WORD end"), (505, " ".join(r["text"] or "" for r in rows[:3]))]
    return spark.createDataFrame([(*x, 1, "s") for x in asked], ITEMS)


@pytest.mark.parametrize("shard_bytes", [lexical.SHARD_BYTES, 40_000, 1])
def test_lexical_search(docs, rows, items, shard_bytes):  # noqa: F811
    got = Counter(tuple(r) for r in lexical.rank_documents(docs, items, shard_bytes=shard_bytes).collect())
    assert got == brute_ranks(rows, items.collect())


def test_lexical_search_of_nothing(docs, empty, items):  # noqa: F811
    assert lexical.rank_documents(empty, items).count() == 0
    assert lexical.rank_documents(docs, items.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_early_end_changes_nothing(seed):
    """Bounds reject blocks unread, and never a document of the heap."""
    rng = np.random.default_rng(seed)
    n = 20_000
    m = rng.integers(30, 300, n)
    lists = []
    for share in (0.5, 0.3, 0.2, 0.01, 0.002):
        doc = np.flatnonzero(rng.random(n) < share)
        tf = rng.geometric(0.4, len(doc))
        _, _, head, _, payload, _ = lexical.pack_lists(np.zeros(len(doc), np.int64), doc, tf, m)
        lists.append((int(5000 * (1 - share) ** 8) + 1, head.tobytes(), payload.tobytes()))
    early, full = ([(w, lexical.Postings(h, p, m)) for w, h, p in lists] for _ in range(2))
    a, b = lexical.best_of_shard(early, n, 10), lexical.best_of_shard(full, n, 10, stop_early=False)
    assert a[0].tolist() == b[0].tolist() and a[1].tolist() == b[1].tolist()
    assert all(p.open.all() for _, p in full)
    assert sum(int(p.open.sum()) for _, p in early) < 0.8 * sum(len(p.open) for _, p in early)


def test_wide_gaps_and_counts():
    doc = np.array([3, 4, 70_000, 70_001, 20_000_000])
    tf = np.array([1, 300, 70_000, 2, 1])
    m = np.full(20_000_001, 100)
    _, _, head, _, payload, _ = lexical.pack_lists(np.zeros(5, np.int64), doc, tf, m)
    p = lexical.Postings(head.tobytes(), payload.tobytes(), m)
    p.need([0])
    assert p.docs.tolist() == doc.tolist() and p.gain.tolist() == lexical.impacts(tf, m[doc]).tolist()
