"""Each operator against brute force on small tables: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quire.llm import arrow_tokens, bpe, clusters, embedding_dedup, exact_dedup, html_main, minhash_dedup, mixing, queries, sharding, toxicity, url_filter

os.environ["TOKENIZERS_PARALLELISM"] = "false"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [a + b for a in ("ka", "lo", "mi", "tu", "ve") for b in ("ra", "sen", "dor", "pit", "un")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """Null and empty texts, one long text, exact and near copies, repeated rows, null ids and sources."""
    rng = random.Random(3)
    base = [prose(rng, rng.randint(1, 60)) for _ in range(60)] + [prose(rng, 20000), "", None, " \t\n", "one", "ONE", "é ü ß", "日本 語"]
    base += [base[0]] * 5 + [base[1] + " extra", base[2].replace(" ", "\n", 3)]
    out = [(k, t, "en", rng.choice(["a", "b", None, "hot", "hot", "hot"]), len(t or "")) for k, t in enumerate(base)]
    return out + [out[3], out[3], (None, "null id", "en", "a", 7), (None, base[0], None, None, None), (7, "other text of id 7", "en", "b", 1)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    """With columns whose names the operators use inside, too."""
    made = spark.createDataFrame(rows, DOCS)
    return made.withColumns({c: F.lit("clash") for c in ("h", "size", "node", "key", "digest", "own", "score", "a", "b", "root")})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def as_set(text, width):
    w = (text or "").encode().lower().split()
    return frozenset([tuple(w)] if 0 < len(w) < width else zip(*(w[k:] for k in range(width)), strict=False))


def test_shared_folder(spark, monkeypatch):
    """A cluster must name one; what was written can be deleted."""
    import types

    from quire.llm import common

    bare = types.SimpleNamespace(master="spark://m:7077", getConf=lambda: types.SimpleNamespace(get=lambda k: None))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(types.SimpleNamespace(sparkContext=bare, conf=types.SimpleNamespace(get=lambda k, d: d)))
    monkeypatch.setattr(common, "_made", [])
    common.written(spark.range(3), "gone")
    path = common._made[0].removeprefix("file://")
    assert os.path.isdir(path) and common.delete_written(spark) == 1 and not os.path.isdir(path)


# 1


@pytest.mark.parametrize("limit", [300, 5000, 10**9])
def test_shards_fit_and_follow_the_directory(spark, docs, rows, duck, limit):
    got = sharding.shards(docs, limit).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    held = defaultdict(list)
    for r in got:
        held[r.depth, r.prefix, r.page].append(r)
    for (depth, prefix, _), shard in held.items():
        total = sum(r.n_bytes for r in shard)
        assert total == shard[0].shard_bytes and (total <= limit or len(shard) == 1)
        assert 0 <= prefix < 1 << depth
    import pandas as pd

    documents = pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source", "n_chars"]).astype({"doc_id": "Int64"})  # noqa: F841
    sql = queries.shard_sql(limit).replace("FROM documents", "FROM made_documents")
    duck.register("made_documents", documents)
    key = lambda r: repr(tuple(r))
    want = duck.sql(f"SELECT doc_id, n_bytes, depth, prefix, page, shard_bytes FROM ({sql})").fetchall()
    assert sorted(map(key, got)) == sorted(map(key, want))


def test_shards_of_nothing(none):
    assert sharding.shards(none).count() == 0


# 2


@pytest.mark.parametrize("keep", ["max", "min"])
@pytest.mark.parametrize("digest_bytes", [32, 1, 0])
def test_exact_dedup(docs, rows, keep, digest_bytes):
    """With cut digests all texts collide, and bytes decide."""
    groups = defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r[0])
    best = {t: (max if keep == "max" else min)([i for i in ids if i is not None], default=None) for t, ids in groups.items()}
    got = exact_dedup.assign(docs, keep, digest_bytes).collect()
    want = Counter((r[0], best[r[1] or ""], len(groups[r[1] or ""]), hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in rows)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert Counter(r.text_sha256 for r in got if r.kept) == Counter(hashlib.sha256(t.encode()).hexdigest() for t in groups)


def test_kept_texts_differ(docs, rows, none):
    for digest_bytes in (32, 1):
        got = exact_dedup.kept_documents(docs, "max", digest_bytes)
        assert got.columns == docs.columns
        assert sorted((r.text or "") for r in got.collect()) == sorted({r[1] or "" for r in rows})
    assert exact_dedup.kept_documents(none).count() == 0 and exact_dedup.assign(none).count() == 0


def test_index_of_many_levels(spark):
    """Memtables of 50 entries and a fan-out of 3: five levels of ranges, and the same index as by grouping."""
    rng = random.Random(21)
    made = [(bytearray(hashlib.sha256(bytes([rng.randint(0, 250), rng.randint(0, 9)])).digest()), rng.randint(-(10**6), 10**6)) for _ in range(6000)]
    want = defaultdict(list)
    for d, i in made:
        want[bytes(d)].append(i)
    got = exact_dedup.build_index(spark.createDataFrame(made, "digest binary, id long"), 50, 40, 3).collect()
    assert {(bytes(r.digest), r.id, r.group_size) for r in got} == {(d, min(i), len(i)) for d, i in want.items()} and len(got) == len(want)


def test_rows_that_repeat_the_one_that_stays(spark):
    """5,000 rows alike in id and text: one is kept, whatever its other columns."""
    made = [(7, "same", "en", rng_source, 4) for rng_source in ["a", "b"] * 2500] + [(3, "same", "en", "a", 4), (8, "other", "en", "a", 5)]
    df = spark.createDataFrame(made, DOCS).repartition(6)
    got = Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.assign(df, "max").collect())
    assert got == {(7, 7, 5001, True): 1, (7, 7, 5001, False): 4999, (3, 7, 5001, False): 1, (8, 8, 1, True): 1}
    for digest_bytes in (32, 1, 0):
        assert sorted((r.doc_id, r.text) for r in exact_dedup.kept_documents(df, "max", digest_bytes).collect()) == [(7, "same"), (8, "other")]


def test_runs_merge_as_dictionaries_do():
    rng = random.Random(1)
    entries = [(hashlib.sha256(bytes([rng.randint(0, 40)])).digest(), rng.randint(-50, 50)) for _ in range(400)]
    runs = []
    for k in range(0, 400, 40):
        part = defaultdict(list)
        for d, i in entries[k : k + 40]:
            part[d].append(i)
        names = sorted(part)
        runs.append(exact_dedup.Run(np.array(names, "S32"), np.array([min(part[d]) for d in names]), np.array([len(part[d]) for d in names])))
    one = exact_dedup.compact(runs)
    want = defaultdict(list)
    for d, i in entries:
        want[d].append(i)
    assert [x.tobytes() for x in one.digests.view("V32")] == sorted(want)
    assert one.ids.tolist() == [min(want[d]) for d in sorted(want)] and one.counts.tolist() == [len(want[d]) for d in sorted(want)]
    assert one.filter.may_have(one.digests).all()


# 3


def page(k, body, host="h.example"):
    return (k, f"https://{host}/p{k}", f"<html><head><title>t</title></head><body><div class='x9'>All rights, {host}</div>{body}<div>Page foot of {host}</div></body></html>")


PAGES = "page_id long, url string, html string"


def test_recurring_subtrees_go(spark):
    made = [page(k, f"<div><p>Story {k} &amp; more</p><p>Shared passage</p></div>") for k in range(8)]
    made += [page(100 + k, f"<article><h1>T{k}</h1><p>Shared passage</p><div>Like us</div><p>own {k}<br>x</p></article>", "b.example") for k in range(8)]
    made += [(200, None, None), (201, "", ""), (202, "u", "<p>no host")]
    df = spark.createDataFrame(made, PAGES).withColumns({"host": F.lit(1), "text": F.lit(2), "hash": F.lit(3)})
    for limit in (10**6, 0):
        got = {r.page_id: r for r in html_main.extract(df, broadcast_rows=limit).collect()}
        assert got[3].text == "Story 3 & more" and got[3].n_chars == 14
        assert got[103].text == "T3\nShared passage\nown 3 x"
        assert (got[200].text, got[201].text, got[202].text) == ("", "", "no host")
    assert html_main.extract(spark.createDataFrame([], PAGES)).count() == 0


def test_copies_of_a_page_keep_their_text(spark):
    body = "<article><h1>T</h1><ul><li>one</ul><div>plain</div></article>"
    made = [(k, "https://c.example/p", f"<body>{body}</body>") for k in range(8)]
    made += [(20 + k, "https://d.example/p", f"<body><article><p>own {k}</p><ol><li>shared</ol><div><p>passage</p></div></article></body>") for k in range(8)]
    made += [(40 + k, "https://e.example/p", f"<head><title>{k}</title></head><body><p>all alike</p></body>") for k in range(8)]
    got = {r.page_id: r.text for r in html_main.extract(spark.createDataFrame(made, PAGES)).collect()}
    assert (got[3], got[23], got[43]) == ("T\none\nplain", "own 3\nshared\npassage", "all alike")


def test_recurrence_alone_tells_template_from_text(spark):
    """No article element, no telling names, attributes that differ from page to page: with counting the template goes, without it stays."""
    rng = random.Random(33)
    made, want = [], {}
    for host in ("one.example", "two.example"):
        for k in range(12):
            own = [prose(rng, 30) for _ in range(3)]
            menu = f"<div data-n='{k}'><div class='c{k}'>Home</div><div>Prices of {host}</div></div>"
            foot = f"<section id='s{k}'><p>Imprint of <b>{host}</b></p><p>All rights</p></section>"
            body = "".join(f"<p>{x}</p>" for x in own)
            made.append((len(made), f"https://{host}/{k}", f"<html><body>{menu}<div>{body}</div>{foot}</body></html>"))
            want[len(made) - 1] = "\n".join(own)
    df = spark.createDataFrame(made, PAGES)
    assert {r.page_id: r.text for r in html_main.extract(df).collect()} == want
    left = {r.page_id: r.text for r in html_main.extract(df, min_pages=1000).collect()}
    assert all(left[k] != want[k] and "Imprint of" in left[k] and "Home" in left[k] for k in want)


HOSTILE = {
    "cut-off tags": "<a ", "open quotes": "<a b=\"", "unlike quotes": "<a b=\"'>x", "open divs": "<div>", "deep lists": "<ul><li>", "list items in divs": "<li><div>",
    "items closed": "<div><li></li>", "end tags": "</div></p>", "cells": "<table><tr><td>", "cells alone": "<td><b>", "headers": "<header><h1>t", "articles": "<article>a", "paragraphs": "<p><b><i>",
    "comments": "<!--", "raw": "<script>", "less than": "< <", "declarations": "<!x", "equals": "<a = = ", "entities": "&amp;&#x;", "marks": "<div class='ad nav' ",
}


@pytest.mark.parametrize("name", sorted(HOSTILE))
def test_hostile_pages_take_linear_time(name):
    import time

    def seconds(n):
        text = "<p>start</p>" + HOSTILE[name] * n
        began = time.process_time()
        page = html_main.Page(text)
        page.text({h for h in page.hashes(page.roots()).values() if h % 2})
        return time.process_time() - began

    seconds(100)
    assert seconds(80_000) < max(0.4, 60 * min(seconds(4_000) for _ in range(2))) and seconds(80_000) < 20


def test_what_is_no_article_goes():
    html = """<html><body><header>Site<nav>m</nav></header><div class="cookie-notice">We use</div><main><h1>T &amp; x</h1><p>One <b>two</b><i>three</i><br>four
    <ul><li>a<li>b</ul><aside>side</aside><form>f <input> x</form><div id="comments"><p>nice!</p></div><p>End&nbsp;here<script>var a="<p>";</script></main><div class="sidebar">s</div><footer>f</footer>"""
    assert html_main.Page(html).text(set()) == "T & x\nOne twothree four\na\nb\nEnd here"
    assert html_main.Page("<article><p>a<article class='comment'><p>c</p></article></article><p>z").text(set()) == "a"
    assert html_main.Page("<p>cut off <b").text(set()) == "cut off"
    assert html_main.Page("<p title=it's>a</p><p title='b>c'>d 1 < 2</p><!-->e<p class=\"x>f</p>").text(set()) == "a\nd 1 < 2\ne\nf"
    assert html_main.Page("x" * 10**6).text(set()) == "x" * 10**6


def test_pages_of_the_corpus(spark):
    import html as entities

    from conftest import DATA

    df = spark.read.parquet(f"{DATA}/pages.parquet")
    got = {r.page_id: r.text for r in html_main.extract(df).collect()}
    for r in df.collect():
        blocks = re.split(r"</?(?:h1|p)\b[^>]*>", re.search(r"(?s)<article>(.*?)</article>", r.html)[1])
        want = [" ".join(entities.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in blocks]
        assert got[r.page_id] == "\n".join(b for b in want if b)


# 4


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(4)
    made, labels = [], []
    for k in range(900):
        toxic = k % 9 == 0
        words = prose(rng, rng.randint(20, 60)).split()
        for _ in range(3 * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(["Zork!", "zorkified", "blarg,"]))
        made.append((k, " ".join(words), "en", "a", 1))
        if k % 2 == 0:
            labels.append((k, 1, int(toxic)))
    made += [(9000, None, None, None, None), (9001, "", None, None, None), (None, "zork blarg zork", None, None, None)]
    docs = spark.createDataFrame(made, DOCS).withColumn("score", F.lit("clash"))
    labelled = spark.createDataFrame(labels + [(None, None, None), labels[0]], "doc_id long, quality int, toxic int")
    got = toxicity.judged(docs, labelled).collect()
    assert len(got) == len(made)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode() if r.doc_id is not None else b"") % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        if r.doc_id is not None:
            assert r.predicted == int(r.doc_id < 9000 and r.doc_id % 9 == 0)
    kept = toxicity.kept_documents(docs, labelled)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted == 0 for r in got)
    empty = spark.createDataFrame([], DOCS)
    assert toxicity.judged(empty, labelled).count() == 0
    assert {r.score for r in toxicity.judged(docs, spark.createDataFrame([], "doc_id long, toxic int")).collect()} == {0.0}


def test_toxicity_of_long_texts_and_clashing_names(spark):
    """A mark at the end of 500,000 words counts; columns with names used inside pass through."""
    rng = random.Random(44)
    made = [(k, prose(rng, 40) + (" zork blarg" if k % 5 == 0 else ""), "en", "a", 1) for k in range(300)]
    long = "ka " * 500_000
    made += [(1000, long + "zork blarg", "en", "a", 1), (1001, long, "en", "a", 1)]
    names = ("scored_text", "c0", "c1", "score", "positive", "found", "feature", "p", "u", "toxic", "quality")
    docs = spark.createDataFrame(made, DOCS).withColumns({c: F.lit("clash") for c in names})
    labels = spark.createDataFrame([(k, 1, int(k % 5 == 0)) for k in range(300)], "doc_id long, quality int, toxic int").withColumn("text", F.lit("clash"))
    predicted = {r.doc_id: r.predicted for r in toxicity.judged(docs, labels).collect()}
    assert predicted == {k: int(k % 5 == 0) if k < 1000 else 1001 - k for k in predicted} and len(predicted) == 302
    kept = toxicity.kept_documents(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {k for k, v in predicted.items() if not v}
    assert kept.select(*names).distinct().collect() == [tuple(["clash"] * len(names))]


def test_risk_falls_as_by_finite_differences():
    """The step of training lowers the non-negative risk, worked out plainly."""
    rng = np.random.default_rng(3)
    truth = np.r_[np.ones(200, bool), rng.random(1500) < 0.2]
    x = np.stack([truth & (rng.random(1700) < 0.7), rng.random(1700) < 0.4, rng.random(1700) < 0.1], axis=1).astype(np.float32)
    positive = np.arange(1700) < 200

    def risk(weights, offset, prior=0.2):
        z = x @ weights + offset
        soft = lambda v: np.logaddexp(0, v).mean()
        return prior * soft(-z[positive]) + max(0, soft(z[~positive]) - prior * soft(z[positive]))

    before, after = risk(np.zeros(3), 0.0), risk(*toxicity.train(x, positive, 0.2, decay=0))
    best = toxicity.train(x, positive, 0.2, decay=0)
    around = [risk(best[0] + rng.normal(size=3) * 0.3, best[1] + rng.normal() * 0.3) for _ in range(50)]
    assert after < before and after < np.quantile(around, 0.1)


def test_risk_is_corrected_for_the_prior():
    """Unlabelled examples of which 40 % are positive: the mark still means positive."""
    rng = np.random.default_rng(0)
    truth = np.r_[np.ones(300, bool), rng.random(2000) < 0.4]
    x = np.stack([truth & (rng.random(2300) < 0.9), rng.random(2300) < 0.5], axis=1).astype(np.float32)
    weights, offset = toxicity.train(x, np.arange(2300) < 300, 0.4)
    score = 1 / (1 + np.exp(-(x @ weights + offset)))
    assert score[x[:, 0] == 1].min() > 0.8 and score[x[:, 0] == 0].max() < 0.3


# 5


def test_mix_meets_its_targets(docs, rows, none):
    got = mixing.mix(docs).collect()
    per, taken, target = Counter(), Counter(), {}
    for r in got:
        per[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert r.taken <= 2 * r.size
    assert Counter((r.doc_id, r.size) for r in got) == Counter((r[0], len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))) for r in rows)
    order = sorted((s for s in per if s is not None)) + ([None] if None in per else [])
    weight = dict(zip(order, [5, 2, 1] * len(order), strict=False))
    want, left, open_ = {}, 1.5 * sum(per.values()), set(per)
    while True:  # clamp and share anew
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * per[s]}
        if not over:
            want.update(share)
            break
        want.update({s: 2 * per[s] for s in over})
        left -= sum(2 * per[s] for s in over)
        open_ -= over
    assert {s: round(t, 6) for s, t in target.items()} == {s: round(t, 6) for s, t in want.items()}
    biggest = {s: max(r.size for r in got if r.source == s) for s in per}
    for s in per:
        assert abs(taken[s] - target[s]) <= biggest[s]
    again = mixing.mix(docs).collect()
    assert Counter((r.doc_id, r.size, r.taken) for r in got) == Counter((r.doc_id, r.size, r.taken) for r in again)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    copies = Counter(r.doc_id for r in mixed.collect())
    for r in got:
        copies[r.doc_id] -= r.copies
    assert not any(copies.values())
    assert mixing.mix(none).count() == 0 and mixing.mixed_documents(none).count() == 0


@pytest.mark.parametrize("n", [2, 6, 50])
def test_mix_of_equal_sizes(spark, duck, n):
    """Running sums of buckets meet the rest exactly: half of the documents are taken once more."""
    import pandas as pd

    made = [(k, f"word{k} more", "en", "a", 1) for k in range(n)]
    got = mixing.mix(spark.createDataFrame(made, DOCS)).collect()
    duck.register("equal_documents", pd.DataFrame(made, columns=["doc_id", "text", "lang", "source", "n_chars"]))
    want = duck.sql(queries.MIX_SQL.replace("FROM documents", "FROM equal_documents")).fetchall()
    assert sorted((r.doc_id, r["size"], r.source_size, r.target, r.taken) for r in got) == sorted(want)
    assert sum(r.taken for r in got) == 3 * n


def test_mix_of_many_sources_and_blank_texts(spark, duck):
    """Sources are ranked in ranges; texts of white space of any kind have no words and aren't taken a second time."""
    import pandas as pd

    rng = random.Random(55)
    blank = ["\t\n", " ", "\x0b\x0c\r", "", "\u2003", "\xa0 x"]
    made = [(k, rng.choice([*blank, prose(rng, rng.randint(1, 30))]), "en", f"s{rng.randint(0, 400):03d}" if k % 97 else None, 1) for k in range(3000)]
    made += [(9000 + k, "\t\n", "en", "blank", 2) for k in range(20)]
    df = spark.createDataFrame(made, DOCS)
    got = mixing.mix(df).collect()
    duck.register("many_documents", pd.DataFrame(made, columns=["doc_id", "text", "lang", "source", "n_chars"]))
    want = duck.sql(queries.MIX_SQL.replace("FROM documents", "FROM many_documents")).fetchall()
    assert sorted((r.doc_id, r["size"], r.source_size, r.target, r.taken) for r in got) == sorted(want)
    assert {r.doc_id: r.copies for r in got if r.copies} == Counter(r.doc_id for r in mixing.mixed_documents(df).collect())


# 6


def brute_vectors(rows, cosine=0.93):
    good = [(i, np.array(e, float), lab) for i, e, lab in rows if i is not None and lab is not None and e and all(x is not None and np.isfinite(x) for x in e) and any(e)]
    links = defaultdict(int)
    root = {i: i for i, *_ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, e, lab in good:
        for j, f, other in good:
            if i != j and lab == other and len(e) == len(f) and e @ f / np.sqrt((e @ e) * (f @ f)) >= cosine:
                links[i] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (links[i], find(i)) for i, *_ in rows if i is not None}


@pytest.mark.parametrize("block", [4096, 16])
def test_embeddings(spark, block):
    rng = np.random.default_rng(6)
    made, k = [], 0
    for _ in range(25):
        centre = rng.normal(size=24)
        for _ in range(int(rng.integers(1, 40))):
            made.append((k, (centre + rng.normal(size=24) * rng.choice([0, 0.05, 0.2, 0.3])).astype(np.float32).tolist(), int(rng.integers(0, 2))))
            k += 1
    made += [(k, None, 1), (k + 1, [0.0] * 24, 1), (k + 2, [float("nan")] + [1.0] * 23, 1), (k + 3, [None] + [1.0] * 23, 1), (k + 4, made[0][1], None), (k + 5, [], 0), (k + 6, [1.0, 2.0], 0), (k + 7, [2.0, 4.0], 0), (None, [1.0] * 24, 0)]
    df = spark.createDataFrame(made, "vec_id long, embedding array<float>, label int").withColumn("node", F.lit("clash"))
    got = {r.vec_id: r for r in embedding_dedup.dedup(df, block=block).collect()}
    want = brute_vectors(made)
    assert {i: (r.n_links, r.component_id) for i, r in got.items() if i is not None} == want
    # vectors that share the first bits of their hash stay strangers
    clashing = embedding_dedup.dedup(df, block=block, node_bits=5).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in clashing if r.vec_id is not None} == want
    assert all(r.kept == (r.component_id == i) for i, r in got.items()) and got[None].n_links == 0
    assert embedding_dedup.dedup(df.limit(0)).count() == 0


def test_hashing_recall_at_the_threshold():
    rng = np.random.default_rng(0)
    a = rng.normal(size=(2000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.normal(size=(2000, 64))
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    near = 0.93 * a + np.sqrt(1 - 0.93**2) * b
    x, y = embedding_dedup.buckets(a), embedding_dedup.buckets(near)
    hit = (x[:, :, :, None] == y[:, :, None, :]).any((1, 2, 3))
    assert hit.mean() >= 0.999
    assert np.allclose(embedding_dedup.hadamard(embedding_dedup.hadamard(a.T.copy())) / 64, a.T)


@pytest.mark.parametrize("n", [1000, 4000, 11000])
def test_links_survive_unlike_leaders(spark, n):
    """One label whose vectors share a direction (cosine 0.5 to 0.6): leaders of most buckets are unlike both ends of a link. Whole results against brute force, at three sizes."""
    rng = np.random.default_rng(61)
    d = 64
    base = rng.normal(size=(n, d)) + 1.2 * np.ones(d)
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    side = rng.normal(size=(n, d))
    side -= (side * base).sum(1, keepdims=True) * base
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    both = np.concatenate([base, 0.95 * base + np.sqrt(1 - 0.95**2) * side]).astype(np.float32)
    df = spark.createDataFrame([(k, v.tolist(), 1) for k, v in enumerate(both)], "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r for r in embedding_dedup.dedup(df).collect()}
    x = both.astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ends = [np.nonzero(np.triu(x[lo : lo + 2000] @ x.T >= 0.93, lo + 1)) for lo in range(0, 2 * n, 2000)]
    a, b = np.concatenate([e[0] + 2000 * k for k, e in enumerate(ends)]), np.concatenate([e[1] for e in ends])
    links, found = np.bincount(np.r_[a, b], minlength=2 * n), np.array([got[k].n_links for k in range(2 * n)])
    assert (found <= links).all() and found.sum() >= 0.999 * links.sum() and links.sum() >= 2 * n
    root = clusters.local_roots(2 * n, a, b)
    assert np.mean([got[k].component_id == root[k] for k in range(2 * n)]) >= 0.999


@pytest.mark.parametrize("block", [4096, 3])
def test_mates_of_a_bucket_are_all_tested(spark, block):
    """Leader 0 is unlike all others; 1-2, 3-4 and 4-5 are near, and one bucket has them all."""
    near = {(1, 2), (3, 4), (4, 5)}
    members = spark.createDataFrame([(9, k) for k in range(8)] + [(8, 6), (8, 7)], "key long, node long")
    values = members.select("node", F.col("node").cast("string").cast("binary").alias("value")).distinct()

    def test(raw):
        ids = [int(r) for r in raw]
        return lambda k, others: np.array([(min(ids[k], ids[o]), max(ids[k], ids[o])) in near for o in others], bool)

    got = clusters.coarse_clusters(members, lambda pairs: pairs.filter("a > 100"), values, test, block)
    assert {r.node: r.root for r in got.collect()} == {1: 1, 2: 1, 3: 3, 4: 3, 5: 3}


# 7


@pytest.mark.parametrize("width, block", [(2, 10**7), (5, 10**7), (2, 400)])
def test_minhash(spark, width, block):
    rng = random.Random(7)
    made = []
    for _ in range(30):
        words = prose(rng, rng.choice([0, 1, 3, 40, 200])).split()
        for _ in range(rng.choice([1, 2, 12])):
            own = [w if rng.random() > 0.04 else rng.choice(WORDS).upper() for w in words]
            made.append((len(made), rng.choice([" ", "\n", "\t "]).join(own) if own else None, "en", "a", 1))
    made += [(None, made[-1][1], "en", "a", 1), made[5], (len(made) + 3, prose(rng, 15000), "en", "a", 1)]
    df = spark.createDataFrame(made, DOCS).withColumns({c: F.lit("x") for c in ("node", "th", "keys", "root")})
    got = minhash_dedup.dedup(df, width=width, block=block).collect()
    sets = [as_set(r[1], width) for r in made]
    root = list(range(len(made)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= 80 * (len(a) + len(sets[j]) - both):
                root[find(i)] = find(j)
    low = {}
    for i, r in enumerate(made):
        if r[0] is not None:
            low[find(i)] = min(low.get(find(i), 10**9), r[0])
    want = Counter((r[0], len(s), low.get(find(i)) if s else r[0]) for i, (r, s) in enumerate(zip(made, sets, strict=True)))
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == want
    if width == 2:  # sets that share the first bits of their hash stay strangers
        clashing = minhash_dedup.dedup(df, width=width, block=block, node_bits=4).collect()
        assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in clashing) == want
    kept = minhash_dedup.kept_documents(df, width)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect() if r.doc_id is not None} == {r.doc_id for r in got if r.kept and r.doc_id is not None}
    assert minhash_dedup.dedup(df.limit(0)).count() == 0


@pytest.mark.parametrize("pairs, pool, size, own", [(12000, 200, 100, 9), (4000, 150, 90, 10)])
def test_links_survive_alien_band_leaders(spark, pairs, pool, size, own):
    """Texts out of one pool of words, any two at about 0.33 (or 0.43), in pairs at 91 / 109 (or exactly 80 / 100)."""
    rng = np.random.default_rng(71)
    made = []
    for _ in range(pairs):
        words = rng.permutation(pool)
        made += [words[:size], np.r_[words[own:size], words[size : size + own]]]
    rows = [(k, " ".join(f"w{w}" for w in words), "en", "a", 1) for k, words in enumerate(made)]
    got = {r.doc_id: r.component_id for r in minhash_dedup.dedup(spark.createDataFrame(rows, DOCS), width=1).collect()}
    assert np.mean([got[k] == got[k + 1] == k for k in range(0, len(made), 2)]) >= 0.999


@pytest.mark.parametrize("hubs", [1, 3])
def test_a_cluster_of_many_blocks(spark, monkeypatch, hubs):
    """Near copies of one text above the block size, in families whose members are linked through others: components as by brute force, whichever rows are hubs."""
    monkeypatch.setattr(minhash_dedup, "HUBS", hubs)
    rng = random.Random(75)
    base = prose(rng, 120).split()
    made = []
    for family in range(7):  # each family drifts away from the base, and three of them jump
        own = list(base)
        for step in range(30):
            for _ in range(40 if step == 15 and family % 2 else 1):
                own[rng.randrange(len(own))] = f"x{rng.randint(0, 9)}"
            made.append((len(made), " ".join(own), "en", "a", 1))
    sets = [as_set(r[1], 2) for r in made]
    a, b = zip(*[(i, j) for i in range(len(made)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])], strict=True)
    root = clusters.local_roots(len(made), np.array(a), np.array(b))
    for block in (2000, 20_000):
        got = {r.doc_id: r.component_id for r in minhash_dedup.dedup(spark.createDataFrame(made, DOCS), width=2, block=block).collect()}
        assert [got[k] for k in range(len(made))] == root.tolist() and len(set(root)) > 1


def test_null_ids_go_with_their_component(spark):
    """A null id goes where a real one stays; a component of null ids keeps them all, and so do texts without words."""
    long, alone = prose(random.Random(72), 200), prose(random.Random(73), 200)
    made = [(5, long), (None, long), (None, long + " x"), (6, long + " y"), (None, alone), (None, alone + " z"), (None, None), (None, "")]
    df = spark.createDataFrame([(*r, "en", "a", 1) for r in made], DOCS)
    want = [r for r in made if r[1] is None or r == (5, long) or not r[1].startswith(long)]
    assert Counter((r.doc_id, r.text) for r in minhash_dedup.kept_documents(df).collect()) == Counter(want)
    assert Counter(r.doc_id for r in minhash_dedup.dedup(df).collect() if r.kept) == Counter(r[0] for r in want)


def test_full_sets_count_shingles():
    texts = [b"a b c d e f", b"A b  c\nd e f", b"a b", b"", b"a b a b a b a b"]
    for width in (2, 5):
        sets = minhash_dedup.full_sets(texts, width)
        assert [len(s) for s in sets] == [len(as_set(t.decode(), width)) for t in texts]
        assert (sets[0] == sets[1]).all()


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(180)] + [(k, k + 1) for k in range(1000, 1040)] + [(2000, 2000)]
    got = {r.node: r.root for r in clusters.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    ids = sorted({x for e in edges for x in e})
    place = {x: k for k, x in enumerate(ids)}
    root = clusters.local_roots(len(ids), np.array([place[a] for a, _ in edges]), np.array([place[b] for _, b in edges]))
    assert {x: got.get(x, x) for x in ids} == {x: ids[root[place[x]]] for x in ids}


# 8


@pytest.fixture(scope="module")
def word_bpe():
    from tokenizers import Tokenizer

    path = queries.tokenizer_file("word_bpe_49k.json")
    return bpe.Codec(path), Tokenizer.from_file(path), path


ODD = ["", "  ", "Hello world's the_end 123 don't x", "ΣΑΣ ς Σ", "a<|endoftext|>B <|startoftext|>c", "\x1ca b\x1c", "İstanbul ǅ ﬁ é", "日本語テキスト🙂🙂 ab", "x" * 3000, "ab" * 500 + " 12345", "</w> a</w>b", "ͅ α ẞ", "a​b \x85 c d﻿", "!!!???...", "1 22 333"]


def test_codec_equals_the_library(word_bpe):
    codec, library, _ = word_bpe
    rng = random.Random(8)
    letters = "abcdefghijklmnopqrstuvwxyzäéß'.,1 AZ中<|>/\n"
    for text in ODD + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 60))) for _ in range(1500)]:
        ids = library.encode(text, add_special_tokens=False).ids
        assert codec.encode(text) == ids, text
        assert codec.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_every_code_point_is_cut_as_by_the_library(word_bpe):
    codec, library, _ = word_bpe
    points = [chr(x) for x in range(1, 0x3000)] + [chr(x) for x in range(0x3000, 0x110000, 37) if not 0xD800 <= x < 0xE000]
    texts = [c for c in points] + [f"a{c}b" for c in points] + [f"Ab{c}{c}1" for c in points]
    rng = random.Random(88)
    texts += ["".join(chr(rng.randint(0x20, 0x2FFF)) for _ in range(rng.randint(1, 30))) for _ in range(4000)]
    want = library.encode_batch(texts, add_special_tokens=False)
    for text, w, (ids, decoded) in zip(texts, want, codec.blocks(pa.array(texts)), strict=True):
        assert [int(x) for x in ids.split()] == w.ids, [hex(ord(c)) for c in text]


@pytest.mark.parametrize("text", [" <|ENDOFTEXT|> ", "<|STARTOFTEXT|> x", "foo <|startOfText|>", "a<|endoftext|><|EndOfText|>", "\u0558<|endoftext|>\u0558 <|ENDOFTEXT|>", "e\u0301<|endoftext|>", "<|endoftext|>" * 3])
def test_only_the_added_tokens_own_spelling_counts(word_bpe, text):
    codec, library, _ = word_bpe
    ids = library.encode(text, add_special_tokens=False).ids
    assert codec.encode(text) == ids and codec.encode(text) == ids
    assert next(codec.blocks(pa.array([text])))[1].decode() == library.decode(ids, skip_special_tokens=False)


def test_encoded_documents(word_bpe, docs, rows, none):
    _, library, path = word_bpe
    got = bpe.encoded(docs, path, ("ids", "decoded", "ids_sha256", "decoded_sha256")).collect()
    want = Counter()
    for r in rows:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want[r[0], len(ids), tuple(ids), text, hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_tokens, tuple(r.ids), r.decoded, r.ids_sha256, r.decoded_sha256) for r in got) == want
    assert bpe.encoded(none, path).count() == 0


# 9


@pytest.mark.parametrize("sequence, sequences", [(2048, 256), (16, 2)])
def test_files_hold_all_ids(spark, docs, rows, none, tmp_path, sequence, sequences):
    from tokenizers import Tokenizer

    path = queries.tokenizer_file("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    uri = f"file://{tmp_path}/out"
    files = arrow_tokens.write(docs, uri, path, 2, sequence, sequences)
    got = arrow_tokens.read(spark, uri, files).orderBy("start").collect()
    sizes, want = [], Counter()
    for r in rows:
        ids = np.array([*library.encode(r[1] or "", add_special_tokens=False).ids, 2], "<u4")
        want[r[0], len(ids), zlib.crc32(ids.tobytes())] += 1
        sizes.append(len(ids))
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    assert [r.doc_id is None for r in got] == sorted([r.doc_id is None for r in got], reverse=True)
    ids = [r.doc_id for r in got if r.doc_id is not None]
    assert ids == sorted(ids)
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()
    with pa.memory_map(f"{tmp_path}/out/part-{files[0][0]:06d}.arrow") as source:
        file = pa.ipc.open_file(source)
        first, mask = arrow_tokens.sequence_at(file, 0, sequences)
        assert len(first) == sequence and mask.sum() == min(sequence, files[0][2]) and first.dtype == np.uint16
    assert arrow_tokens.round_trip(none, path, 2).count() == 0


def test_files_follow_the_bytes(spark, monkeypatch, tmp_path):
    """Small bounds give many files; 600 rows alike in id and text fill several of them."""
    path = queries.tokenizer_file("byte_bpe_50k.json")
    made = [(5, "all alike, all alike", "en", "a", 1)] * 600 + [(k, prose(random.Random(k), 50), "en", "a", 1) for k in range(40)]
    df = spark.createDataFrame(made, DOCS).repartition(5)
    monkeypatch.setattr(arrow_tokens, "FILE_BYTES", (500, 2000))
    n = sum(len(r[1]) for r in made)
    assert n / 2000 <= arrow_tokens.file_count(df) <= n / 500 + 1 and arrow_tokens.file_count(df.limit(0)) == 1
    files = arrow_tokens.write(df, f"file://{tmp_path}/out", path, 2)
    assert max(f[1] for f in files) < 200 and sum(f[1] for f in files) == len(made)
    got = arrow_tokens.read(spark, f"file://{tmp_path}/out", files).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted(r[0] for r in made)
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()


def test_word_cuts_keep_ids():
    from tokenizers import Tokenizer

    path = queries.tokenizer_file("byte_bpe_50k.json")
    own, library = arrow_tokens.Encoder(path), Tokenizer.from_file(path)
    rng = random.Random(9)
    for text in ODD + [" ", "a\nb", "a\n\nb", " a b", "a  b", "x\n's y", "foo,| bar.\nbaz", "ab?'s x"] + ["".join(rng.choice("abcéß' .,12\n Z中|?!") for _ in range(rng.randint(1, 30))) for _ in range(2000)]:
        assert np.frombuffer(next(own.blocks(pa.array([text]))), own.kind).tolist() == library.encode(text, add_special_tokens=False).ids, text
    spaces = [chr(c) for c in range(0x3100) if chr(c).isspace()] + ["\u180e", "\u200b", "\ufeff", "\x00"]
    texts = [f"{a}b{c}d{e}" for c in spaces for a in ("", "a\n", c) for e in ("", c, "\nf")] + ["", None, "\n", "a\rb", "a\r\nb"]
    texts += ["".join(rng.choice("abcéß' .,12\n Z中|?!") for _ in range(rng.randint(0, 30))) for _ in range(3000)] + ["<|endoftext|> a"]
    want = library.encode_batch([t or "" for t in texts], add_special_tokens=False)
    for text, ids, w in zip(texts, own.blocks(pa.array(texts)), want, strict=True):
        assert np.frombuffer(ids, own.kind).tolist() == w.ids, text


# 10


def test_urls(spark):
    urls = [None, "", "no scheme", "http://COM/en/x", "https://a.example.com/en/7?q=1", "https://example.com/en/8#f", "http://badexample.com/fr/", "https://x.net/de/1", "https://example.net/de/81", "http://u@example.net:80/de/8", "ftp://org/es/?", "http://com", "http://com/EN/", "http://notcom/en/", "http://é.org/es/ü", "http://.com/en/a"] * 2
    pages = spark.createDataFrame([(k // 2 if k % 5 else None, u) for k, u in enumerate(urls)], "page_id long, url string").withColumns({"key": F.lit(1), "rule": F.lit(2), "host": F.lit(3)})
    listed = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]
    assert queries.RULES == listed
    rules = spark.createDataFrame(listed, "host string, path string, verdict string")
    got = url_filter.judge(pages, rules).collect()
    assert {r.path: (r.rule, r.verdict) for r in got if r.host.endswith("net")} == {"/de/1": ("net/de/", "allow"), "/de/81": ("example.net/de/8", "block")}

    def brute(u):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        raw = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(raw) :])[0]
        host = "".join(c.lower() if c.isascii() else c for c in raw)
        fits = [(len(h + p), h + p, v) for h, p, v in listed if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, None, "allow"))
        return host, path, best[1], best[2]

    assert Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got) == Counter((k // 2 if k % 5 else None, *brute(u)) for k, u in enumerate(urls))
    assert {r.verdict for r in url_filter.judge(pages, rules.limit(0)).collect()} == {"allow"}
    assert url_filter.judge(pages.limit(0), rules).count() == 0


def test_long_hosts_and_long_lists(spark):
    """2,000 labels, a path of 100,000 characters; 300 rules of many shapes, of which the longest that fits wins."""
    deep = ".".join(["a"] * 2000)
    made = [(1, f"https://{deep}.b.c/" + "x" * 100_000), (2, "https://b.c/x/1/2/3"), (3, f"https://{deep}/")]
    rules = [("c", "/", "block"), ("b.c", "/xx", "allow"), (deep, "/", "block"), *[("b.c", "/x/" + "1/2/3"[:k], "block") for k in range(6)], *[(f"h{k}.d", "/" + "p" * (k % 40), "block") for k in range(300)]]
    got = url_filter.judge(spark.createDataFrame(made, "page_id long, url string"), spark.createDataFrame(rules, "host string, path string, verdict string")).collect()
    assert {r.page_id: (r.rule, r.verdict) for r in got} == {1: ("b.c/xx", "allow"), 2: ("b.c/x/1/2/3", "block"), 3: (f"{deep}/", "block")}


def test_filter_has_no_false_negatives(spark):
    keys = spark.range(5000).select(F.concat(F.lit("k"), F.col("id")).alias("key"))
    blocks = url_filter.block_count(5000)
    words = url_filter.filter_words(keys, blocks)
    ask = spark.range(20000).select(F.concat(F.lit("k"), F.col("id")).alias("key"), (F.col("id") < 5000).alias("listed"))
    got = ask.select("listed", url_filter.maybe_listed(F.col("key"), words, blocks).alias("maybe")).groupBy("listed").agg(F.avg(F.col("maybe").cast("int")).alias("share")).collect()
    share = {r.listed: r.share for r in got}
    assert share[True] == 1.0 and share[False] < 0.02
