"""Operators over small tables: nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ordina.llm import decontamination, html_extraction, license_scan, near_duplicates, pii, quality_classifier, quality_rules, secret_scan, sentencepieces, token_counts
from ordina.llm import textbytes as tb
from ordina.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
WORDS = [f"w{i}" for i in range(400)]


def prose(seed, n=120):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def changed(text, seed, n):
    w, r = text.split(), random.Random(seed)
    for i in range(n):
        w[r.randrange(len(w))] = f"new{seed}{i}"
    return " ".join(w)


@pytest.fixture(scope="module")
def docs(spark):
    base = prose(1)
    rows = [(1, base), (2, base), (3, changed(base, 1, 1)), (4, prose(2)), (5, None), (6, ""), (7, ""), (8, "two words"), (9, "two words"), (10, "mail a.b@c.example.com or +1 (743) 555-3824"), (10, "mail a.b@c.example.com or +1 (743) 555-3824"), (None, base), (11, prose(3, 20_000)), (12, "▁ \n\n tab\tx")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"lang": F.lit("en"), "source": F.lit(None).cast("string"), "n_chars": F.length("text").cast("bigint")})
    return df.withColumns({c: F.lit("clash") for c in ("n_words", "kept", "spans", "digest", "class_id", "vid", "clean", "score", "ids", "items")})


def test_near_duplicates(docs):
    got = sorted((r["doc_id"] or -1, r["class_id"] or -1) for r in near_duplicates.near_duplicates(docs).collect())
    assert got == sorted([(1, 1), (2, 1), (3, 1), (4, 4), (5, 5), (6, 6), (7, 6), (8, 8), (9, 8), (10, 10), (10, 10), (-1, 1), (11, 11), (12, 12)])
    kept = near_duplicates.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect()) == [1, 4, 5, 6, 8, 10, 11, 12]


def test_near_duplicates_against_brute_force(spark):
    texts = {}
    for g in range(12):
        base = prose(100 + g, 150)
        for k in range(g + 1):
            texts[len(texts)] = changed(base, len(texts), k % 4) if k else base
    sets = {i: {tuple(w[k : k + 5]) for w in [t.split()] for k in range(len(w) - 4)} for i, t in texts.items()}
    of = {i: i for i in texts}
    for i in texts:
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.83 * len(sets[i] | sets[j]):
                a, b = of[i], of[j]
                of = {k: min(a, b) if v in (a, b) else v for k, v in of.items()}
    got = {r["doc_id"]: r["class_id"] for r in near_duplicates.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")).collect()}
    assert all(got[i] == got[of[i]] for i in texts)  # no clear link is lost
    for i in texts:  # and nothing is joined that shares little
        assert len(sets[i] & sets[got[i]]) > 0.3 * len(sets[i] | sets[got[i]])


def near_classes(texts):
    """Classes by verifying every pair of texts that shares a band key."""
    every = tb.of(list(texts.values()))
    weights = near_duplicates.Weights(len(texts), np.zeros(0, np.uint64), np.zeros(0))
    keys = [set(k.tolist()) for k in near_duplicates.signatures(every, weights)[0]]
    found, tf, offsets = near_duplicates.shingles(every)
    weight = weights.of(found, tf)
    sums = [dict(zip(found[a:b].tolist(), weight[a:b].tolist(), strict=True)) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    ids = list(texts)
    of = {i: i for i in ids}
    for x, i in enumerate(ids):
        for y in range(x):
            if keys[x] & keys[y]:
                least = sum(min(w, sums[y].get(s, 0.0)) for s, w in sums[x].items())
                if least >= near_duplicates.SIMILAR * (sum(sums[x].values()) + sum(sums[y].values()) - least):
                    a, b = sorted((of[i], of[ids[y]]))
                    of = {k: a if v == b else v for k, v in of.items()}
    return of


def spread(seed, groups, members):
    """Groups of texts whose similarities within a group lie on both sides of the threshold; no shingle is frequent."""
    out = {}
    for g in range(groups):
        base = prose(seed + g, 150)
        for k in range(members):
            out[len(out)] = changed(base, seed + 1000 * g + k, 2 + k % 3)
    return out


def classes_of(spark, texts):
    rows = near_duplicates.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")).collect()
    return {r["doc_id"]: r["class_id"] for r in rows}


def test_near_duplicates_try_every_candidate(spark):
    texts = spread(7000, 12, 14)
    assert classes_of(spark, texts) == near_classes(texts)


def test_near_duplicates_with_few_equal_samples(spark):
    texts = spread(50000, 12, 14)  # some links at the threshold agree in fewer than 32 samples
    assert classes_of(spark, texts) == near_classes(texts)


@pytest.mark.parametrize("block", [{"BLOCK": 4}, {"BLOCK_BYTES": 8000}, {"LEAST_BLOCK": 2}, {"BLOCK": 2}])
def test_near_duplicates_blocks_of_a_key_all_meet(spark, monkeypatch, block):
    for name, value in block.items():
        monkeypatch.setattr(near_duplicates, name, value)
    texts = spread(9000, 6, 14)
    assert classes_of(spark, texts) == near_classes(texts)


def test_one_id_with_several_texts_keeps_them_apart(spark):
    a, b = prose(61), prose(62)
    docs = spark.createDataFrame([(1, a), (1, b), (2, a), (3, b), (4, changed(b, 5, 1))], "doc_id bigint, text string")
    rows = near_duplicates.near_duplicates(docs).collect()
    assert len({r["class_key"] for r in rows}) == 2 and all(r["class_id"] == 1 for r in rows)
    assert sorted((r["doc_id"], r["text"]) for r in near_duplicates.deduplicate(docs).collect()) == sorted([(1, a), (1, b)])
    links = near_duplicates.verified_links(docs).collect()
    assert [{r["doc_id"], r["other_id"]} for r in links] == [{1, 4}] and links[0]["similarity"] >= 0.8


def test_similarities_of_a_block():
    texts = tb.of([*spread(300, 1, 9).values(), "", "a b", "x y z " * 50])
    weights = near_duplicates.Weights(12, np.zeros(0, np.uint64), np.zeros(0))
    vector = [(np.frombuffer(e, np.uint32), np.frombuffer(w, np.float32)) for e, w in zip(*near_duplicates.vectors(texts, weights), strict=True)]
    got = near_duplicates.Block(vector).similarities(np.arange(12), np.arange(12))
    want = [[near_duplicates.similarity(*x, *y) for y in vector] for x in vector]
    assert np.abs(np.triu(got - want, 1)).max() < 1e-5  # a vertex is never compared with itself


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 130)] + [(200, 201), (201, 202), (202, 200)]
    got = {r["vid"]: r["component"] for r in near_duplicates.components(spark.createDataFrame(edges, "vid bigint, other bigint")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 130)}, 200: 200, 201: 200, 202: 200}


def test_personal_data_and_secrets(docs):
    model = pii.fit(docs)
    rows = {r["doc_id"]: r for r in pii.find(docs, model, ["doc_id"]).collect()}
    assert (rows[10]["n_email"], rows[10]["n_phone"], rows[10]["spans"]) == (1, 1, "email:5:22,phone:26:43")
    assert rows[5]["spans"] == "" and rows[5]["base_sha256"] == rows[6]["base_sha256"]
    out = pii.redacted(docs)
    assert out.columns == docs.columns
    assert {(r["text"], r["n_chars"]) for r in out.where("doc_id = 10").collect()} == {("mail [EMAIL] or [PHONE]", 23)}
    assert secret_scan.find(docs, ["doc_id"]).where("spans != ''").count() == 0


def test_decontaminated(spark, docs):
    items = spark.createDataFrame([(1, " ".join(prose(1).split()[10:40])), (2, None), (None, "x y"), (3, "")], "item_id bigint, text string")
    bench = decontamination.load(items)
    rows = {r["doc_id"]: r for r in decontamination.matches(docs, bench, ["doc_id"]).collect()}
    assert (rows[1]["n_hit"], rows[1]["items"]) == (30, [1]) and rows[4]["n_hit"] == 0 and rows[5]["n_words"] == 0
    out = decontamination.decontaminate(docs, bench)
    assert out.columns == docs.columns and out.count() == docs.count()
    again = decontamination.matches(out, bench, ["doc_id"])
    assert again.agg(F.sum("n_hit")).first()[0] == 0


def test_quality(spark, docs):
    labels = spark.createDataFrame([(1, 1), (4, 1), (6, 0), (8, 0), (9, 0), (9, 1), (None, 1)], "doc_id bigint, quality int")
    model = quality_rules.fit(docs, labels)
    rows = {r["doc_id"]: r for r in quality_rules.score(docs, model, ["doc_id"]).collect()}
    assert rows[5]["n_words"] == 0 and rows[5]["base_failed"] and not rows[5]["kept"] and not rows[1]["base_failed"]
    assert quality_rules.passing(docs, model).columns == docs.columns
    scores = quality_classifier.score(docs, quality_classifier.fit(docs, labels), ["doc_id"])
    assert scores.where("score between 0 and 1").count() == docs.count()


def test_other_operators(docs):
    assert license_scan.scan(docs, ["doc_id"]).count() == 0
    rows = sentencepieces.encode(docs, sentencepieces.Vocabulary.load(), ["doc_id"])
    assert rows.where("round_trip").count() == docs.count()
    assert {r["text"] for r in sentencepieces.decode(rows.where("doc_id = 12"), sentencepieces.Vocabulary.load(), ["doc_id"]).collect()} == {"▁ \n\n tab\tx"}
    pages = docs.select("doc_id", F.concat(F.lit("<article><p>"), "text").alias("html"), "text")
    assert html_extraction.main_text(pages, ["doc_id"]).where("n_chars = 0").count() == 3


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    assert near_duplicates.deduplicate(none).count() == 0
    assert pii.redacted(none).count() == 0
    assert quality_rules.passing(none, quality_rules.fit(none, labels)).count() == 0
    assert quality_classifier.score(none, quality_classifier.fit(none, labels), ["doc_id"]).count() == 0
    bench = decontamination.load(spark.createDataFrame([], "item_id bigint, text string"))
    assert decontamination.decontaminate(none, bench).count() == 0 and decontamination.decontaminate(docs, bench).count() == docs.count()
    assert license_scan.scan(none, ["doc_id"]).count() == 0 and secret_scan.find(none, ["doc_id"]).count() == 0


def test_ledger_is_idempotent_and_additive(spark, tmp_path):
    ledger = token_counts.TokenLedger(spark, str(tmp_path / "ledger"))
    add = spark.createDataFrame([("insert", "s", "en", "t1", 5, 50), ("insert", "s", "en", "t1", 7, 70), ("insert", None, "de", "t1", 1, 9)], "op string, source string, lang string, tokenizer string, n_tokens bigint, n_chars bigint")
    assert ledger.commit("a", add) and not ledger.commit("a", add)
    totals = lambda: {(r["source"], r["lang"], r["tokenizer"]): (r["n_docs"], r["n_tokens"], r["n_chars"]) for r in ledger.totals().collect()}
    assert totals() == {("s", "en", "t1"): (2, 12, 120), (None, "de", "t1"): (1, 1, 9)}
    revise = spark.createDataFrame([("revise", "s", "en", "t2", 9, 71, "s", "en", "t1", 7, 70)], f"{', '.join(f'{c} {k}' for c, k in zip(['op', 'source', 'lang', 'tokenizer', 'n_tokens', 'n_chars', 'old_source', 'old_lang', 'old_tokenizer', 'old_tokens', 'old_chars'], ['string'] * 4 + ['bigint'] * 2 + ['string'] * 3 + ['bigint'] * 2, strict=True))}")
    ledger.commit("b", revise)
    ledger.commit("c", add.where("source is null").withColumn("op", F.lit("delete")))
    want = {("s", "en", "t1"): (1, 5, 50), ("s", "en", "t2"): (1, 9, 71)}
    assert totals() == want
    ledger.compact()
    assert totals() == want and not ledger.commit("b", revise) and ledger.commit("d", add.limit(0)) and totals() == want
    with pytest.raises(Exception, match="unknown op"):
        ledger.commit("e", add.withColumn("op", F.lit("upsert")))


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = QUERIES["op3_quality_classifier"](spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    right, n = rows.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int")), F.count("*")).first()
    assert n > 50 and right > 0.93


def test_token_totals_are_those_of_tidy_distinct_texts(spark):
    import re

    import tiktoken

    con = duckdb.connect()
    tidy = {}
    for i, s, lang, t in con.execute(f"select doc_id, source, lang, text from '{SF}/documents.parquet' order by doc_id").fetchall():
        tidy.setdefault(re.sub(r" ?\n[ \n]*", "\n", re.sub(r"[ \t]+", " ", t or "")).strip(" "), (s, lang))
    import base64

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(token_counts.RANKS, "rb"))}
    coder = tiktoken.Encoding("own", pat_str=token_counts.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {}
    for t, key in tidy.items():
        a = want.setdefault(key, [0, 0, 0])
        a[0], a[1], a[2] = a[0] + 1, a[1] + len(coder.encode_ordinary(t)), a[2] + len(t)
    got = {(r["source"], r["lang"]): [r["n_docs"], r["n_tokens"], r["n_chars"]] for r in QUERIES["op2_token_counts"](spark, SF).collect()}
    assert got == want


def test_pipeline(spark):
    out = corpus_pipeline.run(spark, SF)
    rows = out.collect()
    assert rows and len({r["doc_id"] for r in rows}) == len(rows) and all(r["round_trip"] for r in rows)
    assert len(rows) < spark.read.parquet(f"{SF}/documents.parquet").count()
