import hashlib

import pytest

import corpus_pipeline as p
from tallyspark.llm import bpe, decontam, orderminhash, quality, surrogates


@pytest.fixture(scope="module")
def small(spark, sf_dir, tmp_path_factory):
    """Some 60 documents, among them copies, benchmark passages, junk and personal data."""
    path = str(tmp_path_factory.mktemp("small"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.where("n_chars < 4000").orderBy("doc_id").limit(50).collect()
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").orderBy("item_id").first().text
    base = max((r for r in rows if r.lang == "en" and "!" not in r.text and "*" not in r.text), key=lambda r: len(r.text))
    words = base.text.split(" ")
    more = [base.text, " ".join(words[:10] + ["changed"] + words[11:]), base.text[:600] + " " + item + " " + base.text[600:900][::-1]]
    more += [f"mail x{i}.y@mail.example.com or call +1 (212) 555-01{i:02d}. " + " ".join(reversed(words[20 * i : 20 * i + 60])) for i in range(4)]
    made = [(10_000 + i, t, "en", "src0", len(t)) for i, t in enumerate(more)]
    spark.createDataFrame([tuple(r) for r in rows] + made, docs.schema).coalesce(2).write.parquet(f"{path}/documents.parquet")
    spark.read.parquet(f"{sf_dir}/benchmark.parquet").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages_against_their_operators_rules(spark, small):
    import public_tokenizers
    import tiktoken

    sf_dir = small
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = docs.columns, {r.doc_id: r for r in docs.collect()}
    kept = {r.doc_id for r in quality.op1_quality(spark, sf_dir).collect() if r.kept}
    steps = [docs]
    for _, stage in p.STAGES[:-1]:
        steps.append(p.materialize(stage(spark, steps[-1], sf_dir)))
        assert steps[-1].columns == columns
    rows = [{r.doc_id: r for r in s.collect()} for s in steps]
    assert set(rows[1]) == kept and all(rows[1][d] == before[d] for d in kept)
    # brute force over all pairs of what the rules kept: what stays is the least id of each component
    ids = sorted(kept)
    words = {d: before[d].text.encode().lower().split() for d in ids}
    parent = {d: d for d in ids}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = len(words[a]), len(words[b])
            if min(x, y) >= 0.8 * max(x, y) and len(set(words[a]) & set(words[b])) >= 0.4 * len(set(words[a])) and orderminhash.similar(words[a], words[b]):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    assert set(rows[2]) == {d for d in ids if root(d) == d}
    leaked = {r.doc_id for r in decontam.op5_decontaminate(spark, sf_dir).collect()}
    assert set(rows[3]) == set(rows[2]) - leaked and leaked
    assert set(rows[4]) == set(rows[3])
    for d, r in rows[4].items():
        found = [before[d].text[a:b] for a, b, _, _ in surrogates.find(before[d].text)]
        assert not any(f in r.text for f in found) and (found or r.text == before[d].text) and r.n_chars == len(r.text)
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks_of(bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))), special_tokens={})
    last = p.run(spark, sf_dir).collect()
    assert {r.doc_id: r.ids for r in last} == {d: enc.encode_ordinary(r.text) for d, r in rows[4].items()}
    assert all(r.decoded_sha256 == hashlib.sha256(rows[4][r.doc_id].text.encode()).hexdigest() for r in last)


def test_repeated_and_null_rows(spark, small):
    sf_dir = small
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text, None, "s", 0), (1, text, None, "s", 0), (None, text, "en", "s", 0), (2, None, None, None, None), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = p.near_duplicates(spark, docs, sf_dir).collect()
    assert sorted((r.doc_id, r.text) for r in out) == [(1, text), (2, None)]
    for _, stage in p.STAGES:
        assert stage(spark, docs.limit(0), sf_dir).collect() == []
