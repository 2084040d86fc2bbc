"""The pipeline stage by stage against brute force, and run() against the chain of its stages."""

import re
from collections import Counter

import pytest
import regex

import corpus_pipeline
from llm.test_operators import brute_components, brute_fingerprint, brute_quality, expected_groups, words
from millwright.llm import mixing, quality
from millwright.llm.common import materialize


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    spark.read.parquet("/root/testdata/sf0.001/documents.parquet").write.parquet(f"{folder}/documents.parquet")
    return folder


def brute_clean(text):
    """The text without failing lines, and whether its document stays."""
    lines, bad = (text or "").split("\n"), []
    solid = lambda t: len(re.sub(r"[\x20\x09-\x0D]", "", t))
    for line in lines:
        w = words(line)
        marks = sum(33 <= ord(c) < 127 and not c.isalnum() and c not in ".,;:!?'\"()-" for c in line)
        bars = sum(x in quality.SEPARATORS for x in w)
        furniture = 0 < len(w) <= quality.FURNITURE_WORDS and regex.search(quality.FURNITURE, line)
        bad.append(bool((len(w) >= 4 and (marks >= quality.MARKS * max(1, solid(line)) or bars >= quality.BARS * len(w))) or furniture))
    lost = sum(solid(x) for x, b in zip(lines, bad) if b) / max(1, sum(map(solid, lines)))
    return "\n".join(x for x, b in zip(lines, bad) if not b), not brute_quality(text)[5] and lost <= quality.MAX_LOST


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns = docs.columns
    before = docs.collect()
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, small), "t")
        assert docs.columns == columns
        kept[name] = docs.collect()
    want = Counter((r["doc_id"], brute_clean(r["text"])[0]) for r in before if brute_clean(r["text"])[1])
    assert Counter((r["doc_id"], r["text"]) for r in kept["quality_rules"]) == want
    assert all(r["n_chars"] == len(r["text"]) for r in kept["quality_rules"])
    groups, n = expected_groups(kept["quality_rules"])
    assert {r["doc_id"] for r in kept["exact_dedup"]} == {k[1] for k in groups} and len(kept["exact_dedup"]) == n
    comp = brute_components([brute_fingerprint(r["text"]) for r in kept["exact_dedup"]])
    first = {}
    for r, c in zip(kept["exact_dedup"], comp):
        first[c] = min(first.get(c, r["doc_id"]), r["doc_id"])
    assert {r["doc_id"] for r in kept["simhash_dedup"]} == set(first.values()) and len(kept["simhash_dedup"]) == len(first)
    taken = {r["doc_id"]: (r["size"], r["taken"]) for r in mixing.mix(spark.createDataFrame(kept["simhash_dedup"])).collect()}
    copies = Counter(r["doc_id"] for r in kept["source_mixing"])
    for doc, (size, t) in taken.items():
        assert copies[doc] == (t // size + (2 * (t % size) >= size and t % size > 0) if size else 0)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, small).collect()
    assert sum(r["n_words"] for r in packed) == sum(len(words(r["text"])) for r in kept["source_mixing"])
    bins = Counter()
    for r in packed:
        bins[r["bin_id"], r["bin_capacity"]] += r["n_words"]
    assert all(used <= cap for (_, cap), used in bins.items())
    run = corpus_pipeline.run(spark, small).collect()
    assert Counter((r["doc_id"], r["piece"], r["n_words"]) for r in run) == Counter((r["doc_id"], r["piece"], r["n_words"]) for r in packed)
