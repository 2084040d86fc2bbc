"""The training-data operators against brute force, on small tables with nulls, ties, repeats and clashing columns."""

import hashlib
import io
import math
import os
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from millwright.llm import chat, common, exact_dedup, langid, licenses, mixing, packing, quality, queries, sharding, simhash, tokenbin

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, bucket string, RID int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    """Real texts and odd cases: nulls, empties, blanks, repeats, ties, a very long text."""
    base = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    odd = [
        (9001, None, "en", "src1", 0), (9002, "", None, None, 0), (9003, " \t\n\x0b\x0c\r ", "en", None, 7), (None, "null id text here", "en", "src2", 3),
        (None, "null id text here", "en", "src2", 3), (9004, "same  text\there", "en", "zzz", 3), (9005, "sametexthere", "en", "zzz", 3), (9006, "same text here!", "en", "zzz", 3),
        (9004, "same  text\there", "en", "zzz", 3), (9007, "a b 　c  d  e <|endoftext|> f", "en", "É", 3), (9008, "word " * 30000 + "end", "en", "src1", 3), (9009, "  lead and trail  ", "de", "\U0001f600", 3),
    ]
    rows = [(*r, True, "b", 1) for r in base + odd]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return docs.collect()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]", "", t or "")


def words(t):
    return WORD.findall(t or "")


# --- exact dedup


def expected_groups(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[norm(r["text"])].append(r)
    out = []
    for text, g in groups.items():
        keep = min(g, key=lambda r: (-len(r["text"] or ""), r["doc_id"] is None, r["doc_id"] or 0))
        out += [(r["doc_id"], keep["doc_id"], len(g), hashlib.sha256(text.encode()).hexdigest()) for r in g]
    return Counter(out), len(groups)


@pytest.mark.parametrize("class_bytes", [32, 1, 0])
def test_exact_groups(docs, rows, class_bytes):
    got = exact_dedup.exact_groups(docs, class_bytes=class_bytes).collect()
    want, groups = expected_groups(rows)
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
    kept = [r for r in got if r["kept"]]
    assert len(kept) == groups and all(r["doc_id"] == r["keep_id"] for r in kept)


def test_exact_empty_and_drop(docs, rows, empty):
    assert exact_dedup.exact_groups(empty).count() == 0
    out = exact_dedup.drop_copies(docs)
    assert out.columns == docs.columns and out.count() == expected_groups(rows)[1]


def test_second_reading_may_be_split_otherwise(spark, docs, rows, tmp_path):
    """Row ids are places in files, and an input column may have the name of the row id."""
    path = str(tmp_path / "d")
    docs.withColumn(common.RID, F.lit("own")).repartition(2).write.parquet(path)
    table = spark.read.parquet(path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    dropped = common.materialize(exact_dedup.exact_groups(table).where("not kept").select(F.col("rid").alias(common.RID)), "t")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
        out = common.without_rows(spark.read.parquet(path), dropped)
        assert out.columns == table.columns and {r[common.RID] for r in out.select(common.RID).collect()} == {"own"}
        assert Counter(norm(r["text"]) for r in out.collect()) == Counter({norm(r["text"]) for r in rows})
        near = simhash.drop_near_copies(table)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert near.columns == table.columns and near.count() == simhash.near_groups(docs).where("first").count()


@pytest.mark.parametrize("n", [1, 2, 1000])
def test_rice_round_trip(n):
    values = np.unique(np.random.default_rng(n).integers(0, 1 << 40, n, dtype=np.uint64))
    k, bits = exact_dedup.rice_encode(values, 1 << 40)
    assert (exact_dedup.rice_decode(len(values), k, bits) == values).all()
    if n == 1000:
        assert 8 * len(bits) < n * (40 - math.log2(n) + 3)


# --- sharding


def test_shards(docs, rows, empty, tmp_path):
    got = sharding.shard_digest(sharding.write_shards(docs, str(tmp_path / "s"), bucket_bytes=50_000)).collect()
    want = Counter((r["doc_id"], len((r["text"] or "").encode()) + 16, zlib.crc32((r["text"] or "").encode())) for r in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    counts = [len(slots[s]) for s in range(40)]
    assert max(counts) - min(counts) <= 1 and sum(counts) == len(rows)
    again = sharding.shard_digest(sharding.write_shards(docs, str(tmp_path / "t"), bucket_bytes=50_000)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    other = sharding.shard_digest(sharding.write_shards(docs, str(tmp_path / "u"), bucket_bytes=50_000, seed=5)).collect()
    assert Counter(map(tuple, got)) != Counter(map(tuple, other))
    assert sharding.write_shards(empty, str(tmp_path / "e")).count() == 0


def test_shards_of_repeated_rows(spark, tmp_path):
    """One row that is a third of the table spreads over the buckets like any other."""
    same = spark.range(4000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.when(F.col("id") % 3 > 0, F.repeat(F.lit("word "), F.lit(20))).otherwise("again").alias("text"))
    got = sharding.write_shards(same, str(tmp_path / "s"), shards=10, bucket_bytes=5_000)
    counts = [r["count"] for r in got.where("doc_id is null").groupBy("shard").count().collect()]
    assert got.count() == 4000 and len(counts) == 10 and max(counts) < 200


# --- licences


def test_licenses(spark, docs, rows, empty):
    got = licenses.scan_licenses(docs).collect()
    match = licenses.Matcher()

    def brute(text):
        lines = (text or "").split("\n")
        split = lambda xs: licenses.normalise(pa.array(["\n".join(xs)]))[0].as_py().split()
        units = [split([x]) for x in lines] + [split(lines)]
        at = 0
        for i, x in enumerate([*lines, ""]):
            if not split([x]):
                if i - at > 1:
                    units.append(split(lines[at:i]))
                at = i + 1
        best = {}
        for u in units:
            a = licenses.bigrams(u)
            for name, s, _ in match.rows:
                dice = 2 * len(a & s) / (len(a) + len(s))
                if dice >= licenses.THRESHOLD:
                    best[name] = max(dice, best.get(name, 0))
        return sorted(best), round(max(best.values()), 6) if best else None

    assert Counter((r["doc_id"], tuple(r["licenses"]), r["dice"]) for r in got) == Counter((r["doc_id"], *(lambda b: (tuple(b[0]), b[1]))(brute(r["text"]))) for r in rows)
    assert any(r["license"] for r in got)
    assert licenses.scan_licenses(empty).count() == 0
    mit = "Intro line.\n\n" + licenses.TEMPLATES["MIT"][2].replace("deal in", "\ndeal in") + "\n\nrest"
    one = licenses.scan_licenses(spark.createDataFrame([(1, mit)], "doc_id long, text string")).first()
    assert (one["license"], one["unit"], one["line_no"]) == ("MIT", "paragraph", 2)


# --- quality


def brute_quality(text):
    ws = words(text)
    wins = Counter(tuple(ws[i : i + 5]) for i in range(len(ws) - 4))
    covered = {j for i in range(len(ws) - 4) if wins[tuple(ws[i : i + 5])] > 1 for j in range(i, i + 5)}
    seen, dups = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dups += line in seen
            seen.add(line)
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text or ""), dups, len(covered), len(ws) < 10 or 100 * len(covered) > 20 * len(ws)


def test_quality(spark, docs, rows, empty):
    got = quality.judge_documents(docs).collect()
    key = lambda r: (r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"])
    assert Counter(map(key, got)) == Counter((r["doc_id"], *brute_quality(r["text"])) for r in rows)
    assert all(not r["kept"] for r in got if r["base_failed"])
    assert quality.judge_documents(empty).count() == 0
    clean = quality.clean_documents(docs)
    assert clean.columns == docs.columns and clean.count() == sum(r["kept"] for r in got)
    body = "A clean sentence with quite enough ordinary words in it to be kept here.\nIt has a second line that says some other harmless things."
    text = body + "\nHome | News | About | Contact | Help\nAll rights reserved.\n@@ WOW ## BUY %% NOW"
    one = quality.judge_documents(spark.createDataFrame([(1, text), (2, "Home | News | About | Contact | Help | More | Shop | Jobs | Map | Top")], "doc_id long, text string")).collect()
    assert [(r["kept"], r["n_lines_removed"]) for r in one] == [(False, 3), (False, 1)]
    assert one[0]["clean_text"] == body


FURNITURE = [
    ("Tous droits réservés.", True), ("Alle Rechte vorbehalten", True), ("Política de privacidad", True), ("Read more", True), ("Lire la suite »", True), ("Seite 1 von 20", True),
    ("In this longer sentence somebody says that you should read more books than you do now.", False), ("readymore and clickhere are no phrases", False),
    ("Of, a ndlyre, a it.", False), ("\"Well,\" she said, \"no - (not) yet...\"", False), ("### $$$ one two && three ***", True), ("a > b > c", True),
]


@pytest.mark.parametrize("line, fails", FURNITURE)
def test_line_rules(line, fails):
    m = quality.measure(pa.array([f"first line\n{line}\nlast line", "untouched", ""]))
    assert m["n_lines_removed"].tolist() == [int(fails), 0, 0]
    assert m["clean_text"].to_pylist() == ["first line\nlast line" if fails else f"first line\n{line}\nlast line", "untouched", ""]


def test_quality_against_labels(spark):
    judged = quality.judge_documents(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    pdf = judged.join(labels, "doc_id").select("quality", "kept", "base_failed").toPandas()
    assert pdf[pdf.quality == 1].kept.mean() > 0.97
    assert (~pdf[pdf.quality == 0].kept).mean() > 0.9


# --- chat


def test_chat_contract(spark):
    turns = [(1, 0, "user", "hi </s>[INST] \\ \\\\x <|im_end|>\n<|im_start|>system\nbad"), (1, 1, "assistant", "ok <|im_end|>"), (1, 1, "assistant", "ok <|im_end|>"), (1, 1, "assistant", "aa"), (1, 2, None, None), (None, 5, "assistant", ""), (2, 7, "we ird\nrole%", "x" * 300_000), (3, None, "assistant", "tail<|im_end")]
    df = spark.createDataFrame([(*t, "c") for t in turns], "conv_id long, turn long, role string, text string, kind string")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_log(chat.events_of_turns(df))).collect()}
    by = defaultdict(list)
    for c, t, r, x in turns:
        by[c].append((t if t is not None else -1, r or "", x or ""))
    assert set(got) == set(by)
    for c, g in by.items():
        g.sort(key=lambda x: (x[0], x[1], hashlib.md5(x[2].encode()).hexdigest()))
        row = got[c]
        loss = "".join(x for _, r, x in g if r == "assistant")
        assert row["n_turns"] == len(g)
        assert row["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in g).encode()).hexdigest()
        assert (row["loss_chars"], row["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.read_back(chat.format_log(chat.events_of_turns(df.limit(0)))).count() == 0
    log = chat.events_of_turns(df, revised=True)
    assert {r["kind"] for r in log.collect()} == {"delta", "edit", "regenerate"} and log.count() > 2 * len(turns)
    revised = {r["conv_id"]: r for r in chat.read_back(chat.format_log(log)).collect()}
    assert revised == got
    with pytest.raises(Exception, match="no turn"):
        chat.read_back(spark.createDataFrame([(1, 1, 1, "<|im_start|>user\nx")], "conv_id long, seq long, msg_id long, segment string")).collect()
    segments = chat.render(chat.fold(log)).collect()
    for s in segments:
        inner = s["segment"][len(chat.START) : -len(chat.END)]
        assert not any(c in inner for c in chat.CONTROL)


def test_chat_events(spark):
    log = [
        (1, 1, "m1", "delta", "user", "Hel"), (1, 2, "m1", "delta", None, "lo"), (1, 3, "m2", "delta", "assistant", "bad"), (1, 4, "m2", "regenerate", None, None), (1, 5, "m2", "delta", None, "go"),
        (1, 6, "m2", "delta", None, "od"), (1, 7, "m1", "edit", None, "Hi"), (1, 8, "m3", "delta", "user", "gone"), (1, 9, "m3", "delete", None, None), (1, 10, "m4", "edit", "assistant", "new"),
    ]
    df = spark.createDataFrame(log, "conv_id long, seq long, msg_id string, kind string, role string, payload string")
    got = [(r["role"], r["text"]) for r in chat.fold(df).orderBy("seq").collect()]
    assert got == [("user", "Hi"), ("assistant", "good"), ("assistant", "new")]


# --- mixing


def water_fill(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        level = (total - sum(3 * sizes[s] for s in capped)) / max(1, sum(weight[s] for s in names if s not in capped))
        more = {s for s in names if s not in capped and weight[s] * level > 3 * sizes[s]}
        if not more:
            return {s: 3.0 * sizes[s] if s in capped else weight[s] * level for s in names}
        capped |= more


def simulate_mix(spark, table, targets, sizes, block=mixing.BLOCK_WORDS):
    """Words taken of each row (doc_id, source, size) by walking the schedule slot by slot."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    total = sum(sizes.values())
    edges, at = [], 0.0
    for s in names:
        if targets[s] > 0:
            edges.append((at / total, s))
            at += targets[s]
    slots = Counter()
    for j in range(max(1, round(total / block))):
        u = (j * mixing.GOLDEN % (1 << 64)) / float(1 << 64)
        slots[next(s for lo, s in reversed(edges) if lo <= u)] += 1
    taken = Counter()
    for s in names:
        stop = min(slots[s] * block, math.floor(targets[s]))
        stream = sorted((r["key"], -1 << 65 if r["doc_id"] is None else r["doc_id"], i, r["size"]) for i, r in enumerate(table) if r["source"] == s and r["size"])
        while stop > 0:
            for _, _, i, n in stream:
                taken[i] += min(n, stop)
                stop -= min(n, stop)
    return Counter((r["doc_id"], r["size"], taken[i]) for i, r in enumerate(table))


@pytest.mark.parametrize("range_rows", [1024, 8])
def test_mix_against_a_walk_of_the_schedule(spark, docs, rows, range_rows):
    table = docs.select("doc_id", "source", common.word_count().alias("size"), F.xxhash64(F.lit(mixing.SEED), "doc_id", "text").alias("key")).collect()
    sizes = Counter()
    for r in table:
        sizes[r["source"]] += r["size"]
    want = simulate_mix(spark, table, water_fill(sizes), sizes)
    assert Counter((r["doc_id"], r["size"], r["taken"]) for r in mixing.mix(docs, range_rows=range_rows).collect()) == want
    copies = Counter(r["doc_id"] for r in mixing.mixed_documents(docs, range_rows=range_rows).collect())
    for (doc, size, taken), n in want.items():
        if n == 1 and doc not in (None, 9004) and size:
            assert copies[doc] == taken // size + (2 * (taken % size) >= size and taken % size > 0)


def test_mix(docs, rows, empty):
    got = mixing.mix(docs).collect()
    sizes = Counter()
    for r in rows:
        sizes[r["source"]] += len(words(r["text"]))
    want = water_fill(sizes)
    by_id = defaultdict(list)
    for r in rows:
        by_id[r["doc_id"]].append(r)
    assert len(got) == len(rows)
    taken = Counter()
    for r in got:
        source = by_id[r["doc_id"]][0]["source"]
        assert r["size"] == len(words(by_id[r["doc_id"]][0]["text"])) and r["source_size"] == sizes[source]
        assert r["target"] == pytest.approx(want[source], rel=1e-9)
        assert r["taken"] <= 3 * r["size"]
        taken[source] += r["taken"]
    for s, t in want.items():
        assert abs(taken[s] - t) <= 5 * mixing.BLOCK_WORDS, (s, taken[s], t)
    assert Counter(map(tuple, got)) == Counter(map(tuple, mixing.mix(docs).collect()))
    assert mixing.mix(empty).count() == 0
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    copies = Counter((r["doc_id"], r["text"]) for r in mixed.collect())
    once = Counter((r["doc_id"], r["text"]) for r in rows)
    sure = [r for r in got if r["size"] and r["taken"] % r["size"] == 0 and r["doc_id"] not in (None, 9004)]
    assert len(sure) >= len(got) - 40
    for r in sure:  # whole passes alone: as many copies
        text = by_id[r["doc_id"]][0]["text"]
        assert copies[r["doc_id"], text] == r["taken"] // r["size"]
    assert set(copies) <= set(once) and max(copies.values()) <= 6


# --- simhash


def brute_fingerprint(text):
    ws = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(ws[i : i + 4]) for i in range(max(1, len(ws) - 3))] if ws else []
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps):
    """Component of each of the (id, fingerprint) rows: ids as sets."""
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def test_simhash(docs, rows, empty):
    got = simhash.near_groups(docs).collect()
    fps = [brute_fingerprint(r["text"]) for r in rows]
    comp = brute_components(fps)
    smallest = {}
    for r, c in zip(rows, comp):
        if r["doc_id"] is not None:
            smallest[c] = min(smallest.get(c, r["doc_id"]), r["doc_id"])
    want = Counter((r["doc_id"], f"{f:016x}", smallest.get(c)) for r, f, c in zip(rows, fps, comp))
    assert Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got) == want
    assert sum(r["first"] for r in got) == len(set(comp))
    assert simhash.near_groups(empty).count() == 0
    out = simhash.drop_near_copies(docs)
    assert out.columns == docs.columns and out.count() == len(set(comp))


@pytest.mark.parametrize("limit", [65_536, 40, 3])
def test_links_connect_all_near_pairs(spark, limit):
    """Hot families, with buckets over and under the limit."""
    rng = np.random.default_rng(limit)
    values = {0, (1 << 64) - 1}
    for centre in rng.integers(0, 1 << 63, 6).tolist():
        for _ in range(60):
            x = centre
            for b in rng.choice(64, rng.integers(0, 7), replace=False).tolist():
                x ^= 1 << b
            values.add(x)
    values = sorted(values)
    signed = [simhash.signed(v) for v in values]
    df = spark.createDataFrame([(v,) for v in signed], "fp long")
    labels = {r["node"]: r["label"] for r in simhash.components(simhash.links(df, bucket_limit=limit)).collect()}
    got, want = defaultdict(set), defaultdict(set)
    for v, s, c in zip(values, signed, brute_components(values)):
        got[labels.get(s, s)].add(v)
        want[c].add(v)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_covering_masks():
    masks = simhash.covering_masks(4, list(range(64)))
    rng = np.random.default_rng(0)
    for _ in range(3000):
        diff = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
        assert any(diff & m == 0 for m in masks)


def test_components_of_a_chain(spark):
    n = 300
    edges = spark.createDataFrame([(i * 7 % n, (i + 1) * 7 % n) for i in range(n - 1)], "a long, b long")
    assert {r["label"] for r in simhash.components(edges).collect()} == {0}


# --- token planes


def test_tokens(docs, rows, empty, tmp_path):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenbin.tokenizer_path())
    manifest = tokenbin.write_tokens(docs, str(tmp_path / "t"), block=1000, files=3)
    got = tokenbin.read_digests(manifest).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == sorted((r["doc_id"] for r in rows), key=lambda i: (i is not None, i or 0))
    at, digests = 0, defaultdict(list)
    for r in rows:
        ids = np.array([*tok.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4")
        digests[r["doc_id"]].append((len(ids), zlib.crc32(ids.tobytes())))
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
        digests[r["doc_id"]].remove((r["n_tokens"], r["ids_crc32"]))
    assert tokenbin.read_digests(tokenbin.write_tokens(empty, str(tmp_path / "e"))).count() == 0


@pytest.mark.parametrize("name, whole", [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
def test_encoder_of_each_kind(rows, name, whole):
    """A tokenizer that is no plain byte-level BPE gets whole texts; both give what the library gives."""
    from tokenizers import Tokenizer

    path = tokenbin.tokenizer_path(name)
    encode = tokenbin.PieceEncoder(path)
    assert encode.whole == whole
    texts = [r["text"] or "" for r in rows if len(r["text"] or "") < 20_000][-60:]
    ids, counts = encode(pa.array(texts, pa.string()))
    want = [[*e.ids, tokenbin.END_ID] for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert counts.tolist() == list(map(len, want)) and ids.tolist() == sum(want, [])


@pytest.mark.parametrize("planes", [4, 32])
def test_plane_file(planes):
    class Sink(io.BytesIO):
        def close(self):
            pass

    rng = np.random.default_rng(planes)
    sink = Sink()
    writer = tokenbin.PlaneWriter(sink, planes, block=100)
    sizes = [0, 1, 99, 100, 101, 350, 0]
    all_ids = [rng.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32) for n in sizes]
    for i, ids in enumerate(all_ids):
        writer.add(np.array([-(1 << 63) if i == 1 else i]), np.array([len(ids)]), ids, np.array([i != 2]))
    writer.close()
    reader = tokenbin.PlaneReader(sink)
    assert [d for d, _ in reader.documents()] == [0, -(1 << 63), None, 3, 4, 5, 6]
    assert all((a == b).all() and len(a) == len(b) for a, (_, b) in zip(all_ids, reader.documents()))
    assert len(reader.index) == math.ceil(sum(sizes) / 100)
    assert (reader.block(2) == np.concatenate(all_ids)[200:300]).all()


# --- packing


def test_packing(docs, rows, empty):
    got = packing.pack(docs, capacities=(64, 256, 1024), block_docs=50).collect()
    pieces = defaultdict(list)
    bins = defaultdict(list)
    for r in got:
        if r["bin_id"] is None:
            assert r["n_words"] == 0
            continue
        pieces[r["doc_id"]].append(r)
        bins[r["bin_id"]].append(r)
    total = sum(len(words(r["text"])) for r in rows)
    assert sum(r["n_words"] for r in got) == total
    for r in rows:
        if r["doc_id"] in (None, 9004) or not words(r["text"]):
            continue
        own = sorted(pieces[r["doc_id"]], key=lambda p: p["piece"])
        assert [p["piece_start"] for p in own] == [sum(q["n_words"] for q in own[:i]) for i in range(len(own))]
        assert sum(p["n_words"] for p in own) == len(words(r["text"]))
    for b in bins.values():
        b.sort(key=lambda r: r["bin_offset"])
        assert [r["bin_offset"] for r in b] == [sum(q["n_words"] for q in b[:i]) for i in range(len(b))]
        used = sum(r["n_words"] for r in b)
        assert all(r["bin_used"] == used and r["bin_capacity"] == min(c for c in (64, 256, 1024) if c >= used) for r in b)
    assert total / sum(b[0]["bin_capacity"] for b in bins.values()) > 0.85
    assert packing.pack(empty).count() == 0


def test_best_fit_prefers_the_fullest_bin():
    bins, offsets, caps, used, _ = packing.best_fit([60, 50, 38, 10], (100,), 0)
    assert bins == [0, 1, 0, 1] and used == [98, 60] and offsets == [0, 0, 60, 50]
    assert packing.best_fit([10], (16, 100), 5)[2] == [16]


def brute_pack(sizes, capacities, overhead, attention):
    """The rule as it is stated, piece by piece over plain lists."""
    bins = []  # [room, when it got this room, fill, opened]
    out = []
    for i, s in enumerate(sizes):
        rest = sizes[i + 1 :]
        fits = [b for b in bins if b[0] >= s]
        if fits:
            b = min(fits, key=lambda b: (b[0], -b[1]))
        else:
            weighed = []
            for c in sorted(capacities):
                if c < s:
                    continue
                room = c - s
                for x in rest:  # in descending order
                    if x <= room:
                        room -= x
                weighed.append(((overhead + c + c * c / attention) / (c - room), c))
            c = min(weighed)[1]
            b = [c, i, 0, c]
            bins.append(b)
        out.append((bins.index(b) if bins.count(b) == 1 else next(k for k, x in enumerate(bins) if x is b), b[2]))
        b[0], b[1], b[2] = b[0] - s, i, b[2] + s
    return out, [(min(c for c in capacities if c >= b[2]), b[2], b[3]) for b in bins]


@pytest.mark.parametrize("seed", range(12))
def test_best_fit_against_brute_force(seed):
    rng = np.random.default_rng(seed)
    sizes = sorted((int(x) for x in np.minimum(200, rng.geometric(1 / rng.integers(5, 80), rng.integers(1, 120)))), reverse=True)
    got = packing.best_fit(sizes, (25, 50, 100, 200), 4, 300)
    want, ends = brute_pack(sizes, (25, 50, 100, 200), 4, 300)
    assert list(zip(*got[:2])) == want and list(zip(*got[2:])) == ends


def test_several_lengths_are_opened(spark):
    got = packing.pack(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    opened = Counter(r["bin_opened"] for r in got.where("bin_id is not null").select("bin_id", "bin_opened", "bin_capacity", "bin_used").distinct().collect())
    assert len(opened) >= 3, opened


# --- language ID


def test_language_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    held = langid.identify(docs.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, F.col("lang"))), pages)
    out = held.where("doc_id is not null").select("doc_id", F.col("lang").alias("got")).join(docs.where("doc_id % 2 = 1"), "doc_id").toPandas()
    assert (out.got == out.lang).mean() > 0.95
    found = held.where("page_id is not null").toPandas()
    assert len(found) == pages.count() and (found.lang == found.declared).mean() > 0.7
    assert ((found.confidence > 0) & (found.confidence <= 1)).all()


def test_language_fusion_against_brute_force(spark):
    """The posterior recomputed row by row from the text likelihoods, by the formulas of the module."""
    rng = np.random.default_rng(3)
    langs = ["aa", "bb", "cc"]
    spec = [(i, f"h{i % 4}.s{i % 2}.x", f"s{i % 2}.x", ["x", "y", ""][i % 3], ["aa", "", "bb", "zz"][i % 4], [float(v) for v in rng.uniform(-6, 0, 3)]) for i in range(40)]
    frame = spark.createDataFrame(spec, "id long, host string, site string, suffix string, declared string, ll array<double>")
    got = {r["id"]: r for r in langid.fuse(frame, langs).collect()}
    p = np.array([np.exp(r[5]) / np.exp(r[5]).sum() for r in spec])
    group = lambda k: {v: p[[r[k] == v for r in spec]].sum(axis=0) for v in {r[k] for r in spec}}
    host, site, suffix, declared = (group(k) for k in (1, 2, 3, 4))
    mix = p.sum(axis=0) + 1
    whole = mix / mix.sum()
    smooth = lambda counts, own, below: (np.maximum(counts - own, 0) + langid.KAPPA * below) / (max(counts.sum() - 1, 0) + langid.KAPPA)
    for r, own in zip(spec, p):
        prior = smooth(host[r[1]], own, smooth(site[r[2]], own, whole))
        log = np.array(r[5]) + np.log(prior)
        for value, table in ((r[3], suffix), (r[4], declared)):
            if value:
                log += np.log((table[value] + langid.KAPPA * whole) / (mix.sum() * whole + langid.KAPPA))
        want = np.exp(log - log.max())
        assert got[r[0]]["lang"] == langs[int(log.argmax())] and abs(got[r[0]]["confidence"] - 1 / want.sum()) < 2e-6
        assert got[r[0]]["text_lang"] == langs[int(np.argmax(r[5]))]


def test_many_languages_and_repeated_rows(spark):
    """Seventy languages stay; a language that is one row repeated is sampled like any other."""
    words_of = lambda i: " ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26)}{chr(97 + k % 26)}" for k in range(30))
    rows = [(i * 10 + k, f"l{i:02d}", words_of(i)) for i in range(70) for k in range(2)] + [(7, "rep", "the very same row")] * 2000
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string").withColumn("source", F.lit("s"))
    langs, table = langid.fit(docs, sample=50)
    assert langs == [f"l{i:02d}" for i in range(70)] + ["rep"] and table.shape == (71, langid.DIMS)
    chosen = langid.chosen_rows(common.pick(common.as_table(docs), "doc_id", "lang", "text", rid=True), 50)
    assert {r["lang"]: r["count"] for r in chosen.groupBy("lang").count().collect()} == {**{f"l{i:02d}": 2 for i in range(70)}, "rep": 50}
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    got = langid.identify(docs.where("lang <> 'rep'"), pages)
    wanted = docs.where("lang <> 'rep'").select("doc_id", F.col("lang").alias("want"))
    assert got.join(wanted, "doc_id").where("text_lang = want").count() == 140


def test_language_odd_rows(spark, docs, empty):
    pages = spark.createDataFrame([(1, None, None, "x"), (2, "notaurl", "", "x"), (3, "https://Ex.Example.FR:80/a", "<html lang='FR'>le de la", "x"), (3, "https://Ex.Example.FR:80/a", "<html lang='FR'>le de la", "x")], "page_id long, url string, html string, host string")
    got = langid.identify(docs, pages)
    assert got.count() == docs.count() + 4
    row = got.where("page_id = 3").first()
    assert (row["host"], row["suffix"], row["declared"], row["lang"]) == ("ex.example.fr", "fr", "fr", "fr")
    assert langid.identify(empty, pages).where("lang is null").count() == 4
    assert langid.identify(empty, pages.limit(0)).count() == 0


# --- registered SQL


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(queries.oracle_sql()[name]).fetchall()
    cols = [c[0] for c in con.description]
    assert Counter(map(tuple, queries.queries()[name](spark, SF).select(cols).collect())) == Counter(want)


def test_shared_path_needs_a_setting(spark):
    assert common.shared_path(spark, "x").rpartition("/")[0]
    assert os.path.isdir(common.shared_path(spark, "x").rpartition("/")[0].removeprefix("file:"))


# --- licence notices in other words


NOTICES = [
    ("Licensed under the MIT License.", "MIT"),
    ("This work is licensed under the MIT License.", "MIT"),
    ("This software is released under the MIT License.", "MIT"),
    ("Licensed under CC BY-ND 4.0.", "CC-BY-ND-4.0"),
    ("Licensed under CC BY-NC-SA 4.0.", "CC-BY-NC-SA-4.0"),
    ("Licensed under CC BY 3.0.", "CC-BY-3.0"),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivs 3.0 Unported License.", "CC-BY-NC-ND-3.0"),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International Licence.", "CC-BY-SA-4.0"),
    ("Copyright 2020 X Inc. All rights reserved.", "Proprietary"),
    ("This work is licensed under the GNU General Public License, version 2.", "GPL-2.0"),
    ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0"),
    ("This work is licensed under the GNU Lesser General Public License, version 3.", "LGPL-3.0"),
    ("This work is licensed under the GNU Lesser General Public License, version 2.1.", "LGPL-2.1"),
    ("This work is licensed under the GNU Affero General Public License, version 3.", "AGPL-3.0"),
    ("You may use it under the terms of the GNU GPL v2 or later, as you like.", "GPL-2.0"),
    ("Released under the GNU General Public License.", "GPL"),
    ("Code is available under the Apache License 2.0.", "Apache-2.0"),
    ("It is distributed under the 2-clause BSD license, see there.", "BSD-2-Clause"),
    ("// SPDX-License-Identifier: LGPL-2.1-or-later", "LGPL-2.1"),
    ("                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Everyone is permitted to copy", "GPL-3.0"),
    ("MIT License\n\nCopyright (c) 2020 X", "MIT"),
    ("Some words before. " + licenses.TEMPLATES["GPL-2.0"][0] + " And more words after it that belong to the same line of text, and a few others " * 3, "GPL-2.0"),
    ("Intro\n" + licenses.TEMPLATES["GPL-3.0"][1].replace("GNU General", "GNU\nAffero General") + "\nand so on and on " * 9, "AGPL-3.0"),
    ("One may compare the MIT entry, the licensed fishers of Apache county, and rights of others.", None),
]


def test_license_notices(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(NOTICES)], "doc_id long, text string")
    got = {r["doc_id"]: (r["license"], r["licenses"]) for r in licenses.scan_licenses(df).collect()}
    assert [got[i] for i in range(len(NOTICES))] == [(n, [n] if n else []) for _, n in NOTICES]


def test_license_windows_against_all_windows():
    """Every window of a template's length, one by one."""
    windows = licenses.Windows()
    rng = np.random.default_rng(3)
    for k, (name, template, s) in enumerate(windows.rows):
        noise = [f"w{i}" for i in rng.integers(0, 9, 30)]
        text = noise[:17] + [w for w in template if rng.random() > 0.04] + noise[17:]
        want = None
        for i in range(len(text) - len(template) + 1):
            unit = text[i : i + len(template)]
            dice = 2 * len(licenses.bigrams(unit) & s) / (len(licenses.bigrams(unit)) + len(s))
            if dice >= licenses.THRESHOLD and licenses.agrees(name, template, unit) and (want is None or dice > want[1]):
                want = name, dice, i
        assert windows.best(k, text) == want
        assert want is None or (0, k) in windows.candidates(pa.array(text), np.zeros(len(text), np.int64))


def test_license_anchors():
    anchors = set(licenses.ANCHORS.to_pylist())
    assert [p for table in licenses.phrases() for p in table if not anchors & set(p)] == []


# --- a long tail of small sources


def test_every_source_of_a_long_tail_is_mixed(spark, tmp_path):
    tail = [(i, f"host{i % 40:02d}", "a few words of one short text") for i in range(80)]
    big = [(1000 + i, "zbig", "word " * 700) for i in range(20)]
    spark.createDataFrame(tail + big, "doc_id long, source string, text string").repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    of = {i: s for i, s, _ in tail + big}
    taken, target = Counter(), {}
    for r in queries.queries()["op7_source_mixing"](spark, str(tmp_path)).collect():
        taken[of[r["doc_id"]]] += r["taken"]
        target[of[r["doc_id"]]] = r["target"]
    assert all(taken[s] == math.floor(target[s]) for s in target if target[s] < mixing.BLOCK_WORDS)
    assert sum(t < mixing.BLOCK_WORDS for t in target.values()) == 40
    import corpus_pipeline

    mixed = {r["source"] for r in corpus_pipeline.source_mixing(spark, docs, str(tmp_path)).collect()}
    assert mixed == set(of.values())
    # without it, sources are missing
    plain = Counter()
    for r in mixing.mix(docs).collect():
        plain[of[r["doc_id"]]] += r["taken"]
    assert sum(plain[s] == 0 for s in target) > 5


def test_whole_licence_texts():
    """Each whole text is found under its own name alone, within other text."""
    from millwright.llm.license_notices import FULL_TEXTS

    names = sorted(FULL_TEXTS)
    texts = [f"Some words about a thing.\n\nCopyright 2020 Somebody\n\n{FULL_TEXTS[n][0]}\n\nThe thing goes on here." for n in names]
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(len(names)), pa.int64()), "text": texts})
    out = [r for b in licenses._scan(licenses.TEMPLATES, licenses.THRESHOLD)([batch]) for r in b.to_pylist()]
    assert [(r["license"], r["licenses"]) for r in out] == [(n, [n]) for n in names]


# --- frames that are no bare scan, and rows of equal ids in many files


@pytest.fixture(scope="module")
def exploded(spark, tmp_path_factory):
    """Rows that share places in their file: an explode, a filter on it and a projection."""
    path = str(tmp_path_factory.mktemp("x") / "t")
    spark.createDataFrame([(1, "en", "s", "aa bb,zz one"), (2, "en", "s", "aa bb,yy two")], "doc_id long, lang string, source string, text string").coalesce(1).write.parquet(path)
    return spark.read.parquet(path).withColumn("text", F.explode(F.split("text", ","))).where("text != ''").select("doc_id", "text", "lang", "source")


def test_exploded_frames(exploded, tmp_path):
    assert not common.is_scan(exploded)
    texts = {"aa bb", "zz one", "yy two"}
    assert {r["text"] for r in exact_dedup.drop_copies(exploded).collect()} == texts
    assert Counter(r["kept"] for r in exact_dedup.exact_groups(exploded).collect()) == {True: 3, False: 1}
    assert Counter(r["text"] for r in sharding.write_shards(exploded, str(tmp_path / "s"), shards=3).collect()) == {"aa bb": 2, "zz one": 1, "yy two": 1}
    groups = simhash.near_groups(common.as_table(exploded)).collect()
    assert len(groups) == 4 and simhash.drop_near_copies(exploded).count() == sum(r["first"] for r in groups) == 3
    assert sum(r["taken"] for r in mixing.mix(exploded, block=1).collect()) == 8
    assert Counter(r["text"] for r in mixing.mixed_documents(exploded, block=1).collect()) == {"aa bb": 2, "zz one": 1, "yy two": 1}


def test_scans(spark, exploded, tmp_path):
    exploded.write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    assert common.is_scan(table.where("doc_id > 0").select("text"))
    assert not common.is_scan(table.union(table)) and not common.is_scan(table.where(F.rand() < 2)) and not common.is_scan(table.distinct())


def test_equal_ids_in_many_files(spark, tmp_path):
    """Each file has one row of each language, all without an id: places differ by their files."""
    path = str(tmp_path / "d")
    rows = [(None, f"text {i} of language {k}", f"l{k}", "s", i) for i in range(30) for k in range(10)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, f int").repartitionByRange(30, "f").sortWithinPartitions("lang").write.parquet(path)
    table = spark.read.parquet(path)
    assert len(table.inputFiles()) == 30
    model = langid.fit(table, sample=2)
    assert model[0] == [f"l{k}" for k in range(10)]
    chosen = langid.chosen_rows(common.pick(table, "doc_id", "lang", rid=True), 2).collect()
    assert all(1 <= n <= 2 for n in Counter(r["lang"] for r in chosen).values())
    places = common.pick(table, "doc_id", "text", rid=True).select(sharding._place(1, "doc_id", "text")).distinct().count()
    assert places == 300
    got = sharding.write_shards(table, str(tmp_path / "s"), shards=7, bucket_bytes=500).collect()
    assert max(Counter(r["shard"] for r in got).values()) - min(Counter(r["shard"] for r in got).values()) <= 1


def test_paths_of_token_files(spark, tmp_path):
    """A bare path is one of the default file system, whatever that is."""
    assert tokenbin.qualified(spark, str(tmp_path)) == f"file://{tmp_path}"
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    before = conf.get("fs.defaultFS")
    try:
        conf.set("fs.defaultFS", "viewfs://other/")
        conf.set("fs.viewfs.mounttable.other.link./in", f"file://{tmp_path}")
        assert tokenbin.qualified(spark, "/in/x").startswith("viewfs://other/")
    finally:
        conf.set("fs.defaultFS", before or "file:///")
