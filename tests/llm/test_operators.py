"""Operators against brute force, and on texts of megabytes."""

import itertools
import math
import random
import re
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ordina.llm import decontamination, html_extraction, license_scan, near_duplicates, pii, quality_classifier, quality_rules, secret_scan, sentencepieces, token_counts
from ordina.llm import textbytes as tb
from ordina.llm.common import Taken

MB = 5 << 20
LONG = {
    "digits": "1" * MB, "dots": "1." * (MB // 2), "zeros": "1." + "0" * MB + "1.2.3", "spaces": " " * MB + "x", "lines": "\n " * (MB // 2), "word": "a" * MB, "capitals": "AKIA" + "Z" * MB,
    "at": "@" * MB, "mails": "a@b.c " * (MB // 6), "secret": "password=" + "ab1" * (MB // 3), "guess": "pwd: " + "qz7!" * (MB // 4), "plus": "+1 " * (MB // 3), "license": "this software is provided as is without " * (MB // 40),
}


@pytest.mark.parametrize("kind", LONG)
def test_long_texts(kind):
    """Every text operator's work on one text of 5 MB; each is in proportion to the text."""
    text = LONG[kind]
    one = tb.of([text])
    base = pii.base_spans(text)
    pii.more_candidates(text, base)
    for a, b, k in base[:50]:
        pii.votes(text, a, b, k)
    assert len(base) == {"mails": MB // 6, "zeros": 1}.get(kind, len(base))
    found = secret_scan.base_spans(text)
    guessed = secret_scan.guessed_spans(text, found)
    assert [s[1] for s in guessed] == ([len(text)] if kind == "guess" else [])
    assert len(license_scan.Index().scan(one)) == 0
    bench = decontamination.Benchmark([(1, "a b c d e f g h i j k")]).ready()
    assert not bench.scan(one)[1].any()
    weights = near_duplicates.Weights(1, np.zeros(0, np.uint64), np.zeros(0))
    assert len(near_duplicates.signatures(one, weights)[0][0]) in (0, 16, 32)
    coder = sentencepieces.Coder(VOCABULARY)
    head = text[: 1 << 18]  # the coder reads character by character in Python
    assert coder.decode(np.frombuffer(coder.encode(head), np.int32)) == head.encode()
    assert html_extraction.extract(f"<article><p>{text}</p>") == " ".join(text.split())


VOCABULARY = sentencepieces.Vocabulary.load()


def test_tokens_of_long_white_space():
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(token_counts.RANKS, "rb"))}
    coder = tiktoken.Encoding("own", pat_str=token_counts.PATTERN, mergeable_ranks=ranks, special_tokens={})
    r, n = random.Random(1), token_counts.LONG_SPACE
    for _ in range(20):  # long enough to be cut, short enough for the coder's pattern
        t = "".join(r.choice(["word ", "\n", " \n" * n, " " * (n + r.randrange(9)), "　" * n, "x", "\t"]) for _ in range(6))
        assert token_counts.tokens_of(coder, t) == len(coder.encode_ordinary(t))
    assert token_counts.tokens_of(coder, "a" + " " * MB + "b") > 1000


def test_taken_spans():
    r = random.Random(2)
    for _ in range(300):
        spans = [(a, a + r.randrange(1, 9)) for a in (r.randrange(60) for _ in range(8))]
        taken, plain = Taken(spans[:3]), spans[:3]
        for a, b in spans[3:]:
            free = all(b <= s or e <= a for s, e in plain)
            assert taken.add(a, b) == free
            if free:
                plain.append((a, b))


# operator 1


def plain_decision(found):
    """Both passes, each block by itself, by looking at all others."""
    density = lambda t: (lambda w: sum(x in html_extraction.STOP_WORDS for x in w) / len(w) if w else 0)(re.findall(r"[^\W\d_]+", t.lower()))
    known = any(density(b.text) >= 0.2 for b in found if b.zone >= 0 and len(b.text) >= 70)
    labels = []
    for b in found:
        links, d, n = b.links / len(b.text), density(b.text), len(b.text)
        if b.zone < 0 or (b.zone == 0 and links > 0.5):
            labels.append("bad")
        elif links > 0.5:
            labels.append("short")
        elif b.heading or n < 70:
            labels.append("bad" if "©" in b.text and b.zone == 0 else "short")
        elif d >= 0.3 and (b.zone > 0 or n >= 200):
            labels.append("good")
        elif d >= 0.2 or not known:
            labels.append("near")
        else:
            labels.append("short" if b.zone > 0 else "bad")
    kept = []
    for i, b in enumerate(found):
        def pick(others):
            before = [j for j in others if j < i]
            behind = [j for j in others if j > i]
            return ([max(before)] if before else []) + ([min(behind)] if behind else [])

        decided = [j for j in range(len(found)) if labels[j] in ("good", "bad")]
        near = pick([j for j in decided if found[j].region == b.region]) or ([] if b.zone > 0 else pick([j for j in decided if found[j].zone >= 0]))
        if labels[i] in ("good", "bad"):
            kept.append(labels[i] == "good")
        elif not near:
            kept.append(b.zone > 0 or b.links / len(b.text) <= 0.5)
        elif labels[i] == "near":
            kept.append("good" in [labels[j] for j in near])
        else:
            least = min(abs(i - j) for j in near)
            kept.append("good" in [labels[j] for j in near if abs(i - j) == least])
    strong = any(b.zone == 2 and x == "good" for b, x in zip(found, labels, strict=True))
    inside = sum(len(b.text) for b, k in zip(found, kept, strict=True) if k and b.zone > 0)
    outside = sum(len(b.text) for b, k in zip(found, kept, strict=True) if k and b.zone <= 0)
    return [k and (b.zone > 0 or not (strong or inside >= max(outside, 1))) for b, k in zip(found, kept, strict=True)]


def test_two_passes_against_brute_force():
    r = random.Random(3)
    for _ in range(600):
        found = []
        region = 0
        for _ in range(r.randrange(12)):
            region += r.random() < 0.3
            words = [r.choice(["the", "of", "and"]) if r.random() < r.choice([0.1, 0.25, 0.6]) else r.choice(["stone", "river", "©", "kettle"]) for _ in range(r.choice([1, 4, 12, 20, 60]))]
            text = " ".join(words)
            found.append(html_extraction.Block(text, r.choice([0, 0, len(text)]), 0, region, r.random() < 0.1))
        zones = {g: r.choice([-1, 0, 0, 1, 2]) for g in range(region + 1)}
        for b in found:
            b.zone = zones[b.region]
        assert html_extraction.decide(found) == plain_decision(found)


PROSE = "It is the case that all of the words were on this side of the river and they had not been there. " * 3
BOXES = "kettle spoon table chair lamp stove window carpet mirror basket ladder hammer " * 4


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<article><p>One two.<svg/> three</p><p>rest</p></article>", "One two. three\nrest"),
        ("<article><p>a <object data=x> b</p><p>c</p></article>", "a b\nc"),
        ("<article><p>x <math><mi>y</mi></math> z <svg><text>no<svg><text>no</text></svg></text></svg> w <select><option>q</select> e</p></article>", "x y z w e"),
        ("<p>a <select><option>x<p>next para", "a\nnext para"),
        ("<p>a <noscript><div>no</div></noscript> b</p>", "a b"),
        ("<p>Short one.</p><p>Short two.</p>", "Short one.\nShort two."),
        (f"<div class='post-meta'>By X</div><div class='text'><p>{PROSE}</p></div>", f"By X\n{PROSE.strip()}"),
        (f"<article><section id='discussion'><p>We talk.</p></section><p class='legal-analysis'>Law.</p><p>{PROSE} © 2020</p></article>", f"We talk.\nLaw.\n{PROSE.strip()} © 2020"),
        (f"<div id=content>Hi there</div><p>{PROSE}</p>", f"Hi there\n{PROSE.strip()}"),
        (f"<p>{BOXES}</p><div><p>{PROSE}</p></div><p>{BOXES}</p>", PROSE.strip()),
        (f"<p>{BOXES}</p><p>{BOXES}</p>", f"{BOXES.strip()}\n{BOXES.strip()}"),
        (f"<article><p>{PROSE}</p><p>{BOXES}</p></article><p>{PROSE}</p>", f"{PROSE.strip()}\n{BOXES.strip()}"),
    ],
)
def test_main_text_of(page, want):
    assert html_extraction.extract(page) == want


# operator 2


CHANGES = "op string, source string, lang string, tokenizer string, n_tokens bigint, n_chars bigint"


def one(spark, n):
    return spark.createDataFrame([("insert", "s", "en", "t", n, n)], CHANGES).coalesce(1)


def test_ledger_commits_during_compaction_and_survives_crashes(spark, tmp_path, monkeypatch):
    ledger = token_counts.TokenLedger(spark, str(tmp_path / "ledger"))
    sums = lambda own=ledger: [tuple(r) for r in own.totals().collect()]
    ledger.compact()
    assert sums() == [] and ledger.commit("a/1", one(spark, 1)) and ledger.commit("_b", one(spark, 2))
    claim, other = token_counts.TokenLedger._claim, token_counts.TokenLedger(spark, str(tmp_path / "ledger"))

    def late(self, entry):  # a batch is committed after the compaction has read the log
        monkeypatch.setattr(token_counts.TokenLedger, "_claim", claim)
        assert other.commit("c", one(spark, 4))
        return claim(self, entry)

    monkeypatch.setattr(token_counts.TokenLedger, "_claim", late)
    ledger.compact()
    assert sums() == [("s", "en", "t", 3, 7, 7)] and all(ledger.committed(b) for b in ("a/1", "_b", "c"))
    assert not any(ledger.commit(b, one(spark, 9)) for b in ("a/1", "_b", "c"))

    def crash(self, entry):
        raise OSError("lost")

    monkeypatch.setattr(token_counts.TokenLedger, "_claim", crash)
    for action in (ledger.compact, lambda: ledger.commit("d", one(spark, 8))):
        with pytest.raises(OSError, match="lost"):
            action()
    monkeypatch.setattr(token_counts.TokenLedger, "_claim", claim)
    again = token_counts.TokenLedger(spark, str(tmp_path / "ledger"))
    assert sums(again) == [("s", "en", "t", 3, 7, 7)] and not again.committed("d") and again.commit("d", one(spark, 8))
    again.compact()
    again.vacuum()
    assert sums(again) == [("s", "en", "t", 4, 15, 15)] and all(again.committed(b) for b in ("a/1", "_b", "c", "d")) and again.commit("e", one(spark, 1))


def test_two_writers_of_one_batch(spark, tmp_path):
    told = []
    work = lambda: told.append(token_counts.TokenLedger(spark, str(tmp_path / "ledger")).commit("same", one(spark, 5)))
    threads = [threading.Thread(target=work) for _ in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(told) == [False, False, True]
    assert [tuple(r) for r in token_counts.TokenLedger(spark, str(tmp_path / "ledger")).totals().collect()] == [("s", "en", "t", 1, 5, 5)]


# operator 4


def test_reliabilities_against_plain_expectation_maximisation():
    r = random.Random(4)
    patterns = {}
    for _ in range(400):
        key = (r.choice(["tel", "name"]), tuple(r.choice([-1, 0, 1]) for _ in range(6)))
        patterns[key] = patterns.get(key, 0) + 1
    rows = [k for k, n in patterns.items() for _ in range(n)]  # candidate by candidate
    p = [1 / (1 + math.exp(-1.5 * sum(v))) for _, v in rows]
    for _ in range(100):
        old = p
        prior = {k: (sum(q for q, x in zip(p, rows, strict=True) if x[0] == k) + 1) / (sum(x[0] == k for x in rows) + 2) for k in ("tel", "name")}
        said = {(j, v): (sum(q for q, x in zip(p, rows, strict=True) if x[1][j] == v), sum(1 - q for q, x in zip(p, rows, strict=True) if x[1][j] == v)) for j in range(6) for v in (-1, 0, 1)}
        good, bad = sum(p), len(p) - sum(p)
        p = []
        for kind, votes in rows:
            s = math.log(prior[kind] / (1 - prior[kind]))
            for j, v in enumerate(votes):
                s += math.log((said[j, v][0] + {-1: 2, 0: 2, 1: 4}[v]) / (good + 8)) - math.log((said[j, v][1] + {-1: 4, 0: 2, 1: 2}[v]) / (bad + 8))
            p.append(1 / (1 + math.exp(-s)))
        if max(abs(a - b) for a, b in zip(p, old, strict=True)) < 1e-6:
            break
    got = pii.reliabilities(patterns)
    assert all(abs(got[k] - q) < 1e-4 for k, q in zip(rows, p, strict=True))


def test_span_classifier_learns_its_targets():
    text = "call 555-234-5678 or version 555-234-5678"
    rows = [pii._features(text, 5, 17, "tel"), pii._features(text, 29, 41, "tel")]
    model = pii.SpanClassifier(rows * 20, [1.0, 0.0] * 20)
    assert model.accepts(text, 5, 17, "tel") and not model.accepts(text, 29, 41, "tel")


def test_names_beyond_ascii():
    found = lambda t: [t[a:b] for a, b, _ in pii.more_candidates(t, [])]
    assert found("Herr Jürgen Müller ging, Mme Hélène Dupont-Martin est, Frau Anna von Berg") == ["Jürgen Müller", "Hélène Dupont-Martin", "Anna von Berg"]


# operator 5


def test_repeated_notices_are_found_one_by_one():
    index = license_scan.Index()
    text = "Released under the MIT License. Released under the MIT License.\nreleased under the mit license"
    assert [(m[0], m[3], m[4]) for m in index.scan(tb.of([text]))[0]] == [("MIT/line", 0, 30), ("MIT/line", 32, 62), ("MIT/line", 64, 94)]
    assert len(index.scan(tb.of(["Licensed under CC BY 4.0. " * 3000]))[0]) == 3000


@pytest.mark.parametrize("name", license_scan.TEMPLATES)
def test_each_template_is_itself(name):
    found = license_scan.Index().scan(tb.of([f"intro words {license_scan.TEMPLATES[name]} and the end"]))
    assert [(m[0], m[1]) for m in found[0]] == [(name, 1.0)]


def overlap(template, words):
    """Longest common subsequence, in full."""
    row = [0] * (len(words) + 1)
    for t in template:
        new = [0]
        for j, w in enumerate(words):
            new.append(row[j] + 1 if t == w else max(new[j], row[j + 1]))
        row = new
    return row[-1]


def test_license_coverage_against_full_alignment():
    r = random.Random(5)
    index = license_scan.Index()
    words = lambda t: re.findall(r"[a-z0-9]+", t.lower())
    for _ in range(60):
        name = r.choice(["MIT", "ISC", "Apache-2.0", "GPL-3.0", "MPL-2.0"])
        own = license_scan.TEMPLATES[name].split()
        for _ in range(r.randrange(6)):
            own[r.randrange(len(own))] = r.choice(["", "extra", "two more"])
        text = f"before this {' '.join(own)} after that"
        full = overlap(words(license_scan.TEMPLATES[name]), words(text)) / len(words(license_scan.TEMPLATES[name]))
        found = [m for m in index.scan(tb.of([text])).get(0, []) if m[0] == name]
        assert len(found) == 1 and full - 0.06 <= found[0][1] <= full + 1e-6


# operator 6


def test_benchmarks_in_parts_give_the_same(spark, monkeypatch):
    r = random.Random(6)
    v = [f"v{i}" for i in range(6)]
    items = spark.createDataFrame([(f"i{i}", " ".join(r.choice(v) for _ in range(r.choice([2, 9, 10, 14])))) for i in range(30)], "item_id string, text string")
    docs = spark.createDataFrame([(i, " ".join(r.choice([*v, "zz"]) for _ in range(r.choice([0, 30, 200])))) for i in range(40)], "doc_id bigint, text string").withColumn("items", F.lit("clash"))
    whole = decontamination.load(items)
    want = sorted(map(tuple, decontamination.matches(docs, whole, ["doc_id", "items"]).collect()))
    clean = sorted(map(tuple, decontamination.decontaminate(docs, whole, 0.4).collect()))
    assert 10 < len(clean) < 40 and any(t not in {d.text for d in docs.collect()} for _, t, _ in clean)
    monkeypatch.setattr(decontamination, "MAX_PART_WORDS", 60)
    for size in (64, 2):  # all parts in one sieve, and in several
        monkeypatch.setattr(decontamination, "SIEVE_PARTS", size)
        parts = decontamination.load(items)
        assert parts.parts > 3 and sorted(map(tuple, decontamination.matches(docs, parts, ["doc_id", "items"]).collect())) == want
        out = decontamination.decontaminate(docs, parts, 0.4)
        assert out.columns == docs.columns and sorted(map(tuple, out.collect())) == clean
    assert decontamination.matches(out, whole, ["doc_id"]).agg(F.sum("n_hit")).first()[0] == 0


def test_parts_without_hits_nulls_and_empty_tables(spark, monkeypatch):
    items = spark.createDataFrame([(i, f"one two three item{i}") for i in range(9)] + [(None, "one two"), (10, None), (11, "")], "item_id bigint, text string")
    monkeypatch.setattr(decontamination, "MAX_PART_WORDS", 8)
    parts = decontamination.load(items)
    docs = spark.createDataFrame([(1, None, 0), (1, "", 0), (2, "one two three", 13), (None, "A one two. Three item4 b", 24)], "doc_id bigint, text string, n_chars int")
    assert parts.parts > 2
    assert sorted(map(str, decontamination.matches(docs, parts, ["doc_id", "text"]).select("doc_id", "n_words", "n_hit", "items").collect())) == sorted(map(str, decontamination.matches(docs, decontamination.Items(items.where("item_id = 4")), ["doc_id"]).collect()))
    for keep in (docs.where("text is null"), docs.where("doc_id = 2"), docs.limit(0)):
        assert sorted(map(str, decontamination.decontaminate(keep, parts).collect())) == sorted(map(str, keep.collect()))
    assert [tuple(r) for r in decontamination.decontaminate(docs.where("doc_id is null"), parts, 0.9).collect()] == [(None, "A  b", 4)]


def test_the_sieve_misses_nothing():
    r = np.random.default_rng(4)
    own = r.integers(0, 1 << 63, 20_000).astype(np.uint64)
    bits = decontamination.Bits(len(own))
    bits.add(own)
    assert len(bits.find(own)) == len(own) and len(bits.find(r.integers(0, 1 << 63, 100_000).astype(np.uint64))) < 200


def test_cutting_goes_on_until_nothing_is_hit():
    bench = decontamination.Benchmark([(1, "a b c d")], 4).ready()
    assert decontamination.cut(bench, "x a b a b c d c d y") == ("x    y".replace("    ", "  "), 8)


# operator 9


def test_paths_meet_in_long_runs():
    for text in (" " * 40_960, "ab" * 9000, "=" * 9000, "\n \n" * 3000):
        stream = sentencepieces.StreamingViterbi(VOCABULARY)
        ids = [i for k in range(0, len(text), 300) for i in stream.feed(text[k : k + 300])] + stream.finish()
        assert stream.widest <= 8 * VOCABULARY.longest and b"".join(VOCABULARY.raw[i] for i in ids) == text.encode()


def test_ids_are_about_as_few_as_the_models():
    import sentencepiece

    model, coder = sentencepiece.SentencePieceProcessor(model_file=sentencepieces.VOCABULARY), sentencepieces.Coder(VOCABULARY)
    text = "Despite the heavy rain, the committee decided to hold the annual meeting outdoors as originally planned last month."
    assert len(coder.encode(text)) // 4 <= len(model.encode(text)) + 1


# operator 10


def test_guess_cost_against_all_segmentations():
    r = random.Random(7)
    words = {"pass": 2, "word": 9, "admin": 4, "the": 1}
    for _ in range(200):
        value = "".join(r.choice(["pass", "w0rd", "aa", "ab", "abc", "qwe", "1", "99", "2024", "X", "!"]) for _ in range(r.randrange(1, 4)))[:9]
        low, n = value.lower(), len(value)
        cost = {(i, j): min((c for e, c in secret_scan.segments(value, low, i, words, n) if e == j), default=math.inf) for i, j in itertools.combinations(range(n + 1), 2)}
        best = math.inf
        for cuts in range(n):
            for inner in itertools.combinations(range(1, n), cuts):
                bounds = [0, *inner, n]
                best = min(best, sum(cost[a, b] for a, b in itertools.pairwise(bounds)) + 0.3 * cuts)
        assert secret_scan.guess_cost(value, words=words) == pytest.approx(best)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("dbPassword=Zt4vR81nQw", ["Zt4vR81nQw"]), ("clientSecret: kTqZ!vRw#mPxL", ["kTqZ!vRw#mPxL"]), ("pwd: zqvx!jkwm!tbph!fgrd", ["zqvx!jkwm!tbph!fgrd"]), ("compass: Zt4vR81nQwx", []),
        ("password=${DB_PASSWORD}", []), ("password=%(secret)s", []), ("the secret is zoltrimaraquen", []), ("auth: aaaaaaaaaaaaaaaaaaaaaaaa", []), ("(pwd=Zt4vR81nQw)", ["Zt4vR81nQw"]),
    ],
)
def test_values_in_context(text, want):
    assert [text[a:b] for a, b, _ in secret_scan.guessed_spans(text, [])] == want


# all of them


def test_clashing_and_empty(spark):
    names = ["n_words", "n_hit", "items", "n_ids", "ids", "round_trip", "n_email", "spans", "redacted", "base_sha256", "n_assign", "license", "start", "n_tokens", "n_chars", "score", "kept", "vid", "__text"]
    docs = spark.createDataFrame([(1, "mail a.b@c.example.com under the MIT License"), (2, None), (3, "")], "doc_id bigint, text string").withColumns({c: F.lit("clash") for c in names})
    keep = ["doc_id", *names]
    bench = decontamination.load(spark.createDataFrame([(1, "a b")], "item_id bigint, text string"))
    for run in (
        lambda d: decontamination.matches(d, bench, keep), lambda d: pii.find(d, pii.fit(d), keep), lambda d: secret_scan.find(d, keep), lambda d: sentencepieces.encode(d, VOCABULARY, keep),
        lambda d: token_counts.count_tokens(d, keep), lambda d: html_extraction.main_text(d, keep, "text"), corpus_pipeline.private, corpus_pipeline.pieces,
    ):
        def make(d, run=run):
            return run(d) if run not in (corpus_pipeline.private, corpus_pipeline.pieces) else run(spark, d, "")

        out = make(docs)
        assert len(set(out.columns)) == len(out.columns) and sum(c.startswith("n_hit") or c == "vid" for c in out.columns) >= 1
        assert out.count() == 3 and make(docs.limit(0)).count() == 0
    assert license_scan.scan(docs, keep).count() == 1 and license_scan.scan(docs.limit(0), keep).count() == 0


def test_models_on_repeated_ids(spark):
    docs = spark.createDataFrame([(1, f"text number {i} of a repeated id") for i in range(50)] + [(2, "another one of them")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id bigint, quality int")
    from ordina.llm.common import labelled_sample

    assert len(labelled_sample(docs, labels, "quality", 10)[0]) == 2
    assert quality_rules.score(docs, quality_rules.fit(docs, labels), ["doc_id"]).count() == 51
    assert quality_classifier.score(docs, quality_classifier.fit(docs, labels), ["doc_id"]).count() == 51


# operators 3 and 7: what Spark scores in slices is what each text scores by itself


def test_scores_are_those_of_each_text_alone(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    svm, rules = quality_classifier.fit(docs, labels), quality_rules.fit(docs, labels)
    got = {(r["doc_id"], r["text"]): r["score"] for r in quality_classifier.score(docs, svm, ["doc_id", "text"]).collect()}
    verdicts = {(r["doc_id"], r["text"]): r for r in quality_rules.score(docs, rules, ["doc_id", "text"]).collect()}
    svm.ready()
    flags = np.zeros(1 << svm.bits, bool)
    for (i, t), score in got.items():
        one = tb.of([t])
        words = one.words(tb.NON_SPACE)
        hashes = tb.word_hashes(one.data, words)
        assert score == pytest.approx(svm.probability(quality_classifier.features.hashed(one, words, hashes, svm.bits), flags)[0], abs=1e-8)
        alone, row = quality_rules.measured(one, rules), verdicts[i, t]
        assert row["quality_p"] == pytest.approx(alone["quality_p"][0], abs=1e-8)
        failed = row["n_words"] < 10 or 100 * row["n_repeat_words"] > 20 * row["n_words"]
        assert (row["base_failed"], row["kept"]) == (failed, not failed and row["quality_p"] >= quality_rules.THRESHOLD)


def test_dual_coordinate_descent_finds_the_optimum():
    from ordina.llm.features import _SHORT, dual_coordinate_descent

    r = np.random.default_rng(8)
    rows = [np.sort(r.choice(40, r.integers(3, 12), replace=False)) for _ in range(60)]
    signs, ratio = r.choice([-1, 1], 60), r.normal(0, 6, 40)
    w, bias = dual_coordinate_descent(rows, signs, ratio, 1.0, 400)
    x = np.zeros((60, 41))
    for k, own in enumerate(rows):
        x[k, own] = ratio[own] / (float(ratio[own] @ ratio[own]) + _SHORT) ** 0.5
    x[:, 40] = 1
    loss = lambda v: v @ v / 2 + np.maximum(0, 1 - signs * (x @ v)).sum()
    own = np.append(w, bias)
    best = own.copy()
    for step in range(1, 4000):  # plain subgradient descent from elsewhere comes no lower
        best = best - (best - x.T @ (signs * (signs * (x @ best) < 1))) / (10 + step)
        assert loss(own) <= loss(best) + 1e-2 * max(1, abs(loss(best)))


# the pipeline, stage by stage, against plain loops


def test_pipeline_against_plain_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rules = quality_rules.fit(docs, labels)
    rows = [r.asDict() for r in docs.collect()]
    kept = []
    for r in rows:
        m = quality_rules.measured(tb.of([r["text"]]), rules)
        if m["n_words"][0] >= 10 and 100 * m["n_repeat_words"][0] <= 20 * m["n_words"][0] and m["quality_p"][0] >= quality_rules.THRESHOLD:
            kept.append(r)
    texts = tb.of([r["text"] for r in kept])
    found, _, offsets = near_duplicates.shingles(texts)
    at, df = np.unique(found, return_counts=True)
    often = df > max(near_duplicates.RATE * len(kept), near_duplicates.LEAST)
    weights = near_duplicates.Weights(len(kept), at[often], df[often])
    vectors = [(np.frombuffer(e, np.uint32), np.frombuffer(w, np.float32)) for e, w in zip(*near_duplicates.vectors(texts, weights), strict=True)]
    group = list(range(len(kept)))
    for i in range(len(kept)):
        for j in range(i):
            if min(len(vectors[i][0]), len(vectors[j][0])) >= 0.3 * max(len(vectors[i][0]), len(vectors[j][0])) and near_duplicates.similarity(*vectors[i], *vectors[j]) >= near_duplicates.SIMILAR:
                a, b = group[i], group[j]
                group = [a if g == b else g for g in group]
    first = {}
    for r, g in zip(kept, group, strict=True):
        if g not in first or r["doc_id"] < first[g]["doc_id"]:
            first[g] = r
    bench = decontamination.load(spark.read.parquet(f"{sf}/benchmark.parquet")).part(0).ready()
    clean = []
    for r in first.values():
        n = len(bench.scan(tb.of([r["text"]]))[1])
        text, gone = decontamination.cut(bench, r["text"])
        if gone <= decontamination.MAX_COVERAGE * n:
            clean.append((r["doc_id"], text))
    spans = pii.fit(spark.createDataFrame(clean, "doc_id bigint, text string"))
    coder, want = sentencepieces.Coder(VOCABULARY), {}
    for i, t in clean:
        base = pii.base_spans(t)
        every = sorted([*base, *(s for s in pii.more_candidates(t, base) if spans.accepts(t, *s))], key=lambda s: (s[0], pii.KINDS.index(s[2])))
        want[i] = np.frombuffer(coder.encode(pii.redact(t, every)), np.int32).tolist()
    got = {r["doc_id"]: r["ids"] for r in corpus_pipeline.run(spark, sf).collect()}
    assert got == want
