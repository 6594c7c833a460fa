"""Operators 11 to 13 against brute force, with ties, nulls, hot keys, long texts and empty tables."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from ordina.llm import band_join, substring_dedup, token_alignment
from ordina.llm import textbytes as tb

DOCS = "doc_id bigint, text string"


# operator 11


def alignments(rows):
    """Plain loop over both tokenizers' whole encodings."""
    coders = token_alignment.Tokenizers.load(token_alignment.VOCABULARIES)
    held, count = [], Counter()
    for d, t in rows:
        a, b = (x[0] for x in coders.encode([(" " + t).encode()])) if t else ([], [])
        x, y = [coders.bytes_a[i] for i in a], [coders.bytes_b[i] for i in b]
        if not t or not b"".join(x) == b"".join(y) == (" " + t).encode():
            held.append((d, None))
            continue
        links, groups, i, j, end_a, end_b = [], [([a[0]], [b[0]])], 0, 0, len(x[0]), len(y[0])
        while True:
            links.append((a[i], b[j]))
            step_a, step_b = end_a <= end_b, end_b <= end_a
            if step_a and step_b:
                if i + 1 == len(a):
                    break
                groups.append(([], []))
            if step_a:
                i += 1
                end_a += len(x[i])
                groups[-1][0].append(a[i])
            if step_b:
                j += 1
                end_b += len(y[j])
                groups[-1][1].append(b[j])
        count.update(set(links))
        held.append((d, (len(a), len(b), groups, links)))
    top = {}
    for (a, _), n in count.items():
        top[a] = max(top.get(a, 0), n)
    out = []
    for d, v in held:
        if v is None:
            out.append((d, 0, 0, 0, 0, 0, 0, ""))
        else:
            text = ";".join(f"{','.join(map(str, g))}|{','.join(map(str, h))}" for g, h in v[2])
            out.append((d, v[0], v[1], len(v[2]), len(v[3]), sum(count[k] == top[k[0]] for k in v[3]), sum(count[k] for k in v[3]), hashlib.sha256(text.encode()).hexdigest()))
    return Counter(out)


NAMES = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_alignment_equals_brute_force(spark, monkeypatch):
    r = random.Random(3)
    parts = ["a", "the ", " ", "  ", "\n", "\t", "é", "　", " ", "’ ", "word", "<s>", "<|endoftext|>", "12", "日本", " x", "\r\n", "🙂", "\x00", " ", "'s ", "​", "<0x0A>", "﻿"]
    rows = [(i, "".join(r.choice(parts) for _ in range(r.randrange(0, 25)))) for i in range(700)]
    rows += [(9001, None), (9002, ""), (9003, "▁ x"), (9004, "a ▁"), (None, "hello world"), (9005, " "), (9006, "\n"), (9005, "again"), (9007, "word " * 3000), (9008, "x" * 5000), (9009, "ends in a space ")]
    rows += [(i, "one and the same") for i in range(300)]
    for name, value in (("BLOCK_BYTES", 3000), ("MOST_CHUNKS", 200)):
        monkeypatch.setattr(token_alignment, name, value)
    got = token_alignment.alignment_counts(spark.createDataFrame(rows, DOCS).repartition(3)).select(*NAMES).collect()
    assert Counter(map(tuple, got)) == alignments(rows)
    assert token_alignment.alignment_counts(spark.createDataFrame([], DOCS)).count() == 0


def test_alignment_itself(spark):
    df = spark.createDataFrame([(1, "naïve tokenizers disagree", 5), (2, None, 6), (3, "▁", 7)], "doc_id bigint, text string, a_ids int")
    own = {r["doc_id"]: r for r in token_alignment.aligned(df, ["doc_id", "a_ids", "text"]).collect()}
    whole = {r["doc_id"]: r for r in token_alignment.aligned(df, ["doc_id"], level="group").collect()}
    assert own[1]["a_ids_in"] == 5 and own[2]["a_ids"] == own[3]["b_ids"] == []
    a, b = own[1]["a_cut"], own[1]["b_cut"]
    products = [(i, j) for x0, x1, y0, y1 in zip([0, *a], a, [0, *b], b) for i in range(x0, x1) for j in range(y0, y1)]
    assert list(zip(whole[1]["link_a"], whole[1]["link_b"])) == products
    assert set(zip(own[1]["link_a"], own[1]["link_b"])) <= set(products)
    with pytest.raises(ValueError, match="level"):
        token_alignment.aligned(df, [], level="word")


def test_chunks_of_long_texts():
    """Chunks encode as the whole text does, also a text of megabytes and one without spaces."""
    coders = token_alignment.Tokenizers.load(token_alignment.VOCABULARIES)
    assert coders.split
    for text in ("word, and more\n\n  text " * 60_000, "x1" * 100_000):
        memory = token_alignment.Memory(coders)
        made = token_alignment.measured(memory, tb.of([text]))
        whole, good = coders.align([b" " + text.encode()])
        assert good[0] and tuple(made["sizes"][0]) == (len(whole.a_ids), len(whole.b_ids), len(whole.closed), len(whole.owner_a))
        assert made["digests"][0] == hashlib.sha256(whole.group_texts()[0]).hexdigest()


# operator 12


def pairs(lines, items):
    out = []
    cents = lambda v: None if v is None else int(np.floor(100 * v + 0.5))
    ready = [(s, n, i, (2 * cents(a) + q) // (2 * q)) for s, n, i, q, a in lines if None not in (s, i, q, a) and q]
    for item, price in items:
        p = None if item is None else cents(price)
        met = [(abs(u - p), u, s, n, i) for s, n, i, u in ready if i != item and (abs(u - p) <= 10 or 1000 * abs(u - p) <= 2 * p)] if p is not None else []
        met.sort(key=lambda m: (m[0], m[1], m[2], -(1 << 60) if m[3] is None else m[3], m[4]))
        crc = sum(zlib.crc32(f"{s},{'' if n is None else n},{i}".encode()) for _, _, s, n, i in met)
        tail = (len(met), sum(m[0] for m in met), crc)
        out += [(item, k, *m, *tail) for k, m in enumerate(met[:5], 1)] or [(item, 0, None, None, None, None, None, *tail)]
    return Counter(out)


LINE, ITEM = "sale_id bigint, line_no int, item_id bigint, quantity int, amount double", "item_id bigint, price double"


@pytest.mark.parametrize("ranges", [2, 64])
def test_band_join_equals_brute_force(spark, tmp_path, ranges):
    r = random.Random(ranges)
    lines = [(r.randrange(60), r.choice([1, 2, 2, 3, None]), r.choice([7, r.randrange(30)]), r.randrange(1, 5), r.choice([5.0, 20.0, round(r.uniform(0, 30), 2), round(r.uniform(200, 230), 2)])) for _ in range(900)]
    lines += [(1, 1, 7, 1, 9.0)] * 400 + [(None, 1, 1, 1, 1.0), (1, 1, None, 1, 1.0), (1, 1, 1, None, 1.0), (1, 1, 1, 1, None), (1, 1, 1, 0, 5.0), (5, 5, 5, -2, 10.0), (4, 1, 2, 1, -3.0)]
    items = [(i, r.choice([5.0, 9.0, round(r.uniform(0, 30), 2), round(r.uniform(200, 230), 2)])) for i in range(30)] + [(7, 9.0), (7, 9.0), (7, 9.05), (40, None), (None, 5.0), (41, 5000.0), (42, -3.0), (43, float("nan"))]
    spark.createDataFrame(lines, LINE).repartition(3).write.parquet(f"{tmp_path}/sale_lines.parquet")
    spark.createDataFrame(items, ITEM).write.parquet(f"{tmp_path}/items.parquet")
    old, band_join.RANGES = band_join.RANGES, ranges
    try:
        names = ("item_id", "rank", "gap", "u", "sale_id", "line_no", "line_item_id", "n_pairs", "gap_sum", "lines_crc")
        got = Counter(tuple(x) for x in band_join.op12_band_join(spark, str(tmp_path)).select(*names).collect())
    finally:
        band_join.RANGES = old
    want = pairs(lines, [(i, p) for i, p in items if p is None or p == p] + [(43, None)])
    assert got == want


def test_band_join_of_empty_tables(spark, tmp_path):
    some = {"lines": [(1, 1, 1, 1, 5.0)], "items": [(2, 5.0)]}
    for k, (lines, items, n) in enumerate((([], some["items"], 1), (some["lines"], [], 0), ([], [], 0))):
        spark.createDataFrame(lines, LINE).write.parquet(f"{tmp_path}/{k}/sale_lines.parquet")
        spark.createDataFrame(items, ITEM).write.parquet(f"{tmp_path}/{k}/items.parquet")
        rows = band_join.op12_band_join(spark, f"{tmp_path}/{k}").collect()
        assert len(rows) == n and all(r["rank"] == r["n_pairs"] == 0 and r["gap"] is None for r in rows)


def test_best_lines_leave_enough_for_everyone():
    r = random.Random(4)
    for _ in range(200):
        rows = np.array([(r.randrange(3), r.randrange(9), r.randrange(3), r.choice([1, 1, 1, 2, 3])) for _ in range(r.randrange(1, 60))]).T
        kept, own = {tuple(x) for x in band_join.best(rows).T}, [tuple(x) for x in rows.T]
        for item in (0, 1, 2, 3):
            for u in range(3):
                first = sorted(x for x in own if x[0] == u and x[3] != item)[:5]
                assert set(first) <= kept


# operator 13


def left(rows):
    words = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    least = {}
    for d, w in words:
        for s in range(len(w) - 19) if d is not None else ():
            g = tuple(w[s : s + 20])
            least[g] = min(least.get(g, d), d)
    out = []
    for d, w in words:
        seen, gone = set(), [False] * len(w)
        for s in range(len(w) - 19):
            g = tuple(w[s : s + 20])
            if g in seen or d is not None and least[g] < d:
                gone[s : s + 20] = [True] * 20
            seen.add(g)
        kept = " ".join(x for x, f in zip(w, gone) if not f)
        out.append((d, len(w), sum(gone), kept))
    return Counter(out)


def test_repeats_equal_brute_force(spark, monkeypatch):
    r = random.Random(5)
    text = lambda k, n: " ".join(r.choice("abcdefghij"[:k]) for _ in range(n))
    passages = [text(3, r.randrange(15, 60)) for _ in range(30)] + ["a " * 50, "a b " * 40, "x y z " * 30, "é　ü 日本 " * 25]
    rows = []
    for i in range(500):
        t = r.choice([" ", "\n", "\t "]).join(r.choice([r.choice(passages), text(r.choice([2, 10]), r.randrange(0, 40)), r.choice(passages)[r.randrange(20) :]]) for _ in range(r.randrange(0, 5)))
        rows.append((r.choice([i, i, i, r.randrange(500), None]) if r.randrange(6) == 0 else i, t))
    rows += [(1000, None), (1001, ""), (1002, " \n "), (1003, "w " * 19), (1004, "w " * 20), (1005, "w " * 21)] + [(2000 + i, passages[3]) for i in range(60)]
    monkeypatch.setattr(substring_dedup, "BLOCK_BYTES", 4000)
    monkeypatch.setattr(substring_dedup, "SEGMENT_KEYS", 50)
    got = substring_dedup.repeats(spark.createDataFrame(rows, DOCS).repartition(4), texts=True).collect()
    assert Counter((x.doc_id, x.n_words, x.n_removed, x.kept) for x in got) == left(rows)
    for x in got:
        assert x.kept_sha256 == hashlib.sha256(x.kept.encode()).hexdigest() and sum(b - a for a, b in zip(x.removed[::2], x.removed[1::2])) == x.n_removed
    empty = substring_dedup.repeats(spark.createDataFrame([], DOCS))
    assert empty.count() == 0 and not [t for t in spark.catalog.listTables() if t.name.startswith("ordina_blocks")]


def test_equal_windows_have_equal_anchors():
    """Wherever it stands, a window takes the anchor that its own words decide."""
    r = random.Random(6)
    for k in (2, 3, 8, 200):
        inner = [f"w{r.randrange(k)}" for _ in range(60)]
        found = []
        for _ in range(30):
            around = [[f"w{r.randrange(k)}" for _ in range(r.randrange(0, 30))] for _ in range(2)]
            words = substring_dedup.Words(tb.of([" ".join(around[0] + inner + around[1])]))
            keys = dict(zip(words.windows.tolist(), words.anchors()[0].tolist()))
            found.append([keys[len(around[0]) + s] for s in range(41)])
        assert all(f == found[0] for f in found)


def test_repeats_of_a_long_text():
    text = " ".join(str(i) for i in range(400_000)) + " " + " ".join(str(i) for i in range(1000, 1100))
    words = substring_dedup.Words(tb.of([text]))
    keys, second = words.keys(words.windows)
    order = np.lexsort((second, keys))
    back = [keys[order], second[order], np.zeros(len(order), np.int64)]
    gone = substring_dedup.removed_words(words, np.array([0]), back)
    assert gone.sum() == 100 and gone[-100:].all()
