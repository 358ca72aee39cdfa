import pytest
from conftest import DATA

from quire.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, duck, same_rows, name):
    same_rows(spark, duck, queries.queries()[name], queries.oracle_sql()[name])


def test_every_operator_is_registered():
    names = queries.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))


def test_pipeline_stage_by_stage(spark):
    import corpus_pipeline as p
    from quire.llm import bpe, minhash_dedup, mixing, toxicity
    from quire.llm.common import table, written

    docs = table(spark, DATA, "documents")
    columns = docs.columns
    n = docs.count()
    clean = written(p.drop_toxic(spark, docs, DATA), "t-clean")
    toxic = toxicity.judged(docs, table(spark, DATA, "labels")).filter("predicted = 1").count()
    assert clean.columns == columns and clean.count() == n - toxic
    single = written(p.drop_copies(spark, clean, DATA), "t-single")
    best = {}
    for r in clean.collect():
        best[r.text] = max(best.get(r.text, -1), r.doc_id)
    assert sorted(r.doc_id for r in single.collect()) == sorted(best.values())
    far = written(p.drop_near_copies(spark, single, DATA), "t-far")
    kept = minhash_dedup.dedup(single).filter("kept")
    assert far.columns == columns and sorted(r.doc_id for r in far.collect()) == sorted(r.doc_id for r in kept.collect())
    mixed = written(p.mix_sources(spark, far, DATA), "t-mixed")
    copies = {r.doc_id: r.copies for r in mixing.mix(far).collect()}
    assert {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == {k: v for k, v in copies.items() if v}
    out = p.encode(spark, mixed, DATA).collect()
    codec = bpe.Codec(queries.tokenizer_file("word_bpe_49k.json"))
    text = {r.doc_id: r.text for r in mixed.collect()}
    assert len(out) == mixed.count() and all(list(r.ids) == codec.encode(text[r.doc_id]) for r in out)
    whole = p.run(spark, DATA)
    assert sorted((r.doc_id, r.ids_sha256) for r in whole.collect()) == sorted((r.doc_id, r.ids_sha256) for r in out)


def test_pipeline_with_odd_rows(spark, tmp_path):
    """Nulls in every column, empty, blank and very long texts, repeated rows, columns with names used inside: every stage against brute force."""
    import hashlib
    import random
    from collections import Counter, defaultdict

    import corpus_pipeline as p
    from pyspark.sql import functions as F
    from quire.llm import mixing, toxicity
    from tokenizers import Tokenizer

    rng = random.Random(99)
    word = lambda: "".join(rng.choice("bdklmnrst") + rng.choice("aeiou") for _ in range(3))
    prose = lambda n: " ".join(word() for _ in range(n))
    made, labels = [], []
    for k in range(400):
        toxic = k % 8 == 0
        words = prose(rng.randint(20, 80)).split()
        for _ in range(3 * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(["zork", "blargish"]))
        made.append((k, " ".join(words), "en", rng.choice(["a", "b", "hot", "hot", None]), 1))
        labels.append((k, 1, int(toxic)))
    clean = [r for r in made if r[0] % 8]
    for k, r in enumerate(clean[:60]):  # exact and near copies, some without an id
        made.append((1000 + k, r[1], "en", "hot", 1))
        made.append((None if k % 5 == 0 else 2000 + k, r[1].replace(" ", "\n", 2) + (" extra" if k % 2 else ""), None, "b", 1))
    made += [(3000, None, None, None, None), (3001, "", "en", "a", 0), (3002, "\t\n", "en", "a", 2), (3003, " ", "en", "hot", 1), (None, None, None, None, None), (3004, prose(30_000), "en", "b", 1)]
    made += [clean[3]] * 40 + [made[-1]]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    clash = ("node", "score", "copies", "h", "size", "th", "doc", "digest", "own", "root", "c0", "gone")
    spark.createDataFrame(made, schema).withColumns({c: F.lit("clash") for c in clash}).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    library = Tokenizer.from_file(queries.tokenizer_file("word_bpe_49k.json"))
    key = lambda r: (r.doc_id, r.text)
    for name, stage in p.STAGES[:-1]:
        before = docs
        docs = p.written(stage(spark, before, str(tmp_path)), f"odd-{name}")
        assert docs.columns == before.columns, name
        rows, out = before.collect(), docs.collect()
        got = Counter(map(key, out))
        if name == "toxicity":
            score = toxicity.Scorer(toxicity.fit(before, spark.read.parquet(f"{tmp_path}/labels.parquet")))
            assert got == Counter(key(r) for r in rows if score(r.text) < 0.3)
            kept = {r.doc_id for r in out}
            assert not kept & set(range(0, 400, 8)) and len(kept & {k for k in range(400) if k % 8}) > 0.95 * 350
        elif name == "exact_dedup":
            best = defaultdict(list)
            for r in rows:
                best[r.text or ""].append(-1 if r.doc_id is None else r.doc_id)
            assert Counter((-1 if r.doc_id is None else r.doc_id, r.text or "") for r in out) == Counter((max(ids), t) for t, ids in best.items())
        elif name == "near_dedup":
            words = [(r.text or "").lower().split() for r in rows]
            sets = [frozenset([tuple(w)] if 0 < len(w) < 5 else zip(*(w[k:] for k in range(5)), strict=False)) for w in words]
            order = sorted(range(len(rows)), key=lambda k: (rows[k].doc_id is None, rows[k].doc_id))
            near = [[j for j in order if sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])] for i in range(len(rows))]
            group = list(range(len(rows)))
            for _ in range(8):  # labels spread along the links
                group = [min((group[j] for j in near[i]), key=order.index, default=i) for i in range(len(rows))]
            assert got == Counter(key(rows[i]) for i in range(len(rows)) if not sets[i] or group[i] == i) and len(out) < len(rows)
        else:
            copies = Counter()
            for r in mixing.mix(before).collect():
                copies[r.doc_id] += r.copies
            assert Counter(r.doc_id for r in out) == +copies
    final = p.encode(spark, docs, str(tmp_path)).collect()
    want = Counter()
    for r in docs.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want[r.doc_id, tuple(ids), hashlib.sha256(decoded.encode()).hexdigest()] += 1
    assert Counter((r.doc_id, tuple(r.ids), r.decoded_sha256) for r in final) == want


def test_pipeline_of_nothing(spark, tmp_path):
    import corpus_pipeline as p

    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert p.run(spark, str(tmp_path)).count() == 0
