import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from ordina.llm import quality_rules
from ordina.llm import textbytes as tb

TEXTS = st.lists(st.text("ab é\n\t語🙂|*.", max_size=40), max_size=6)


@settings(max_examples=200, deadline=None)
@given(TEXTS)
def test_words_hashes_and_grams(texts):
    part = tb.of(texts)
    words = part.words(tb.NON_SPACE)
    plain = [re.findall(r"[^\x20\x09-\x0D]+", t) for t in texts]
    assert [part.data[a:b].tobytes().decode() for a, b in zip(words.starts, words.ends, strict=True)] == [w for p in plain for w in p]
    hashes = tb.word_hashes(part.data, words).tolist()
    assert len(set(hashes)) == len({w for p in plain for w in p})
    grams, offsets, firsts = tb.grams(np.array(hashes, np.uint64), words.offsets, 3)
    assert np.diff(offsets).tolist() == [max(len(p) - 2, 0) for p in plain]
    assert all(g in range(len(hashes)) for g in firsts)


def counted(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    inside = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 5)}
    seen, dups = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dups += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dups, len(inside)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.lists(st.sampled_from(["a ", "b ", "é\n", "x|*", "\n", " \n", "a b c d e "]), max_size=30).map("".join)), max_size=5))
def test_quality_counts(texts):
    from ordina.llm.features import LogisticModel

    model = LogisticModel.fit([], [])
    got = quality_rules.measured(tb.of(texts), model)
    rows = zip(*(got[c].tolist() for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), strict=True)
    assert list(rows) == [counted(t) for t in texts]
