import random
import re

import pytest

from ordina.llm import decontamination as dc
from ordina.llm import license_scan, pii, secret_scan
from ordina.llm import textbytes as tb


def luhn(digits):
    total = 0
    for i, c in enumerate(digits[::-1]):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def personal(t):
    out = [(m.start(), m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[ -]", "", m[0])
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), m.end(), "card"))
    out += [(m.start(), m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], pii.BASE_KINDS.index(s[2])))


def secret(t):
    name = "|".join("".join(f"[{c}{c.upper()}]" for c in w) for w in ("password", "passwd", "secret", "token")) + "|[aA][pP][iI]_?[kK][eE][yY]"
    out = [(m.start(), m.end(), "assign") for m in re.finditer(rf"""({name})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 12]
    out += [(m.start(), m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    out += [(m.start(), m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
    return sorted(out, key=lambda s: (s[0], secret_scan.KINDS.index(s[2])))


def test_base_spans_against_plain_patterns():
    r = random.Random(4)
    some = ["a", "é", "@", ".", "1", "2", "0", "25", " ", "-", "+", "(", ")", "b.c", "x@y.z", "1.2.3", "4242424242424242", "\n", "+1 (743) 555-3824"]
    more = ["a", "f", "0", "AKIA", "Z", "PASSWORD", "token", "ſecret", "api_key", '"', " ", "=", ":", "abcdef012345", "Xy_9", "\n"]
    for _ in range(8000):
        t = "".join(r.choice(some) for _ in range(r.randint(0, 25)))
        assert pii.base_spans(t) == personal(t)
        assert not personal(t) or len(pii.flagged(tb.of([t])))
        t = "".join(r.choice(more) for _ in range(r.randint(0, 25)))
        assert secret_scan.base_spans(t) == secret(t)
        assert not secret(t) or len(secret_scan.flagged(tb.of([t])))


def test_reliabilities_follow_agreement():
    good, bad = (1, 1, 1, 0, 1, 0), (-1, -1, 0, -1, -1, -1)
    p = pii.reliabilities({("tel", good): 60, ("tel", bad): 40, ("tel", (1, 0, 0, 0, 0, 0)): 3})
    assert p["tel", good] > 0.95 and p["tel", bad] < 0.05
    assert pii.reliabilities({}) == {}


def test_redaction_joins_overlaps():
    assert pii.redact("a 1234 b", [(2, 6, "card"), (3, 6, "phone")]) == "a [CARD] b"


@pytest.mark.parametrize(("easy", "hard"), [("password", "x7Kp!q9zLm2"), ("qwertyuiop", "Zt4vR81nQw"), ("20240131", "8fk2LmXq01"), ("aaaaaaaa", "a9Xk3pQ8")])
def test_guess_costs(easy, hard):
    assert secret_scan.guess_cost(easy) < 6 < secret_scan.guess_cost(hard)


def test_cost_is_that_of_the_cheapest_segmentation():
    cost = secret_scan.guess_cost
    assert cost("password2024") <= cost("password") + cost("2024") + 0.3 + 1e-9
    assert cost("") == 0 and cost("q") == 1


def test_guessed_spans():
    t = "the password is x7Kp!q9zLm2 ok. pwd: hello123. Password: qwerty12345"
    assert [t[a:b] for a, b, _ in secret_scan.guessed_spans(t, [])] == ["x7Kp!q9zLm2"]
    assert secret_scan.guessed_spans(t, [(16, 27, "hex")]) == []


def test_long_values_are_marked_whole():
    r = random.Random(5)
    for n in (129, 400, 50_000):
        value = "".join(r.choice("abcdefghkmQRSTUVW23456789") for _ in range(n))
        t = f"pwd: {value} end"
        assert secret_scan.guessed_spans(t, []) == [(5, 5 + n, "guess")]
    for _ in range(300):
        value = "".join(r.choice(["pass", "word", "12", "qwe", "2024", "a", "Zx", "9"]) for _ in range(r.randrange(1, 6)))
        cost = secret_scan.guess_cost(value)
        assert secret_scan.guess_cost(value, 8.0) == (cost if cost <= 8.0 else float("inf"))


def brute(doc, items, window):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    w, hit, found = words(doc), set(), set()
    for item, t in items:
        v = words(t)
        n = min(window, len(v))
        windows = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)} if v else set()
        for k in range(len(w) - n + 1):
            if tuple(w[k : k + n]) in windows:
                found.add(item)
                hit |= set(range(k, k + n))
    return len(w), len(hit), sorted(found)


def test_decontamination_against_brute_force():
    r = random.Random(3)
    for _ in range(150):
        v = ["a", "B", "cé", "d1"]
        items = [(i, " ".join(r.choice(v) for _ in range(r.choice([0, 1, 2, 3, 5, 9, 10, 11, 20])))) for i in range(r.choice([1, 3, 6]))]
        docs = [" ".join(r.choice([*v, "zz"]) for _ in range(r.choice([0, 5, 60]))) + r.choice(["", " "]) + (r.choice(items)[1] if r.random() < 0.5 else "") for _ in range(8)]
        window = r.choice([3, 5, 10])
        words, hit, found = dc.Benchmark(items, window).ready().scan(tb.of(docs))
        got = zip(words.counts().tolist(), tb.flag_sums(hit, words.offsets).tolist(), (sorted(found.get(d, ())) for d in range(len(docs))), strict=True)
        assert list(got) == [brute(d, items, window) for d in docs]


def test_license_spans():
    index = license_scan.Index()
    mit = license_scan.TEMPLATES["MIT"]
    changed = " ".join(w for i, w in enumerate(mit.split()) if i % 9)  # one word in nine is gone
    texts = ["Ö. Licensed under the Apache License, Version 2.0. Ende", "nothing here at all", f"code {changed} code", "", "licensed under the moon"]
    found = index.scan(tb.of(texts))
    assert {d: [m[0] for m in v] for d, v in found.items()} == {0: ["Apache-2.0/line"], 2: ["MIT"]}
    name, coverage, matched, start, end = found[0][0]
    assert texts[0].encode()[start:end].decode() == "Licensed under the Apache License, Version 2.0" and coverage == 1.0 and matched == 8
    assert 0.8 < found[2][0][1] < 1
