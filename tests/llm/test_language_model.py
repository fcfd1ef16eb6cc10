"""The language models against Kneser-Ney written out in plain Python, and on texts they haven't seen."""

import math
import random
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pytest

from vitalgauge.llm import language

ORDER = language.ORDER


def plain_symbols(text):
    out = []
    for char in text.lower():
        if char.isalpha():
            out.append(ord(char))
        elif out and out[-1]:
            out.append(0)
    return out + [0] if out and out[-1] else out


class Plain:
    """One language's probabilities by the textbook formula, recursively from plain counts."""

    def __init__(self, texts, alphabet, least):
        self.counts = {k: Counter() for k in range(1, ORDER + 1)}
        for text in texts:
            line = [0] * (ORDER - 1) + plain_symbols(text)
            self.counts[ORDER].update(tuple(line[i : i + ORDER]) for i in range(len(line) - ORDER + 1))
        for k in range(ORDER - 1, 0, -1):
            self.counts[k].update(gram[1:] for gram in self.counts[k + 1])
        self.discount, self.after = {}, {}
        for k, counts in self.counts.items():
            n1, n2 = (sum(1 for n in counts.values() if n == i) for i in (1, 2))
            self.discount[k] = min(0.95, max(0.1, n1 / (n1 + 2 * n2))) if n1 else 0.5
            self.after[k] = defaultdict(list)
            for gram, n in counts.items():
                self.after[k][gram[:-1]].append((gram, n))
        self.alphabet, self.least = alphabet, least

    def p(self, gram):
        if not gram:
            return 1 / self.alphabet
        k = len(gram)
        follow = self.after[k].get(gram[:-1])
        if not follow:
            return self.p(gram[1:])
        least, d, every = self.least if k == ORDER else 1, self.discount[k], sum(n for _, n in follow)
        left = 1 - sum(n - d for _, n in follow if n >= least) / every
        n = self.counts[k][gram]
        return (n - d if n and n >= least else 0) / every + left * self.p(gram[1:])


TEXTS = {
    "de": ["Der Hund und die Katze, der Vogel; der Hund schläft.", "und die und der und das", "Straße 12 über Österreich"],
    "en": ["The cat and the dog and the bird. The dog sleeps.", "the the THE the", "and then: the end"],
    "ja": ["これは日本語の文です。これはペンです", "日本語の本"],
}


@pytest.fixture(scope="module")
def fitted(spark):
    rows = [(lang, text) for lang, texts in TEXTS.items() for text in texts] + [("en", None), (None, "nobody"), ("xx", " 12 ")]
    table = spark.createDataFrame(rows, "lang string, text string")
    return {least: language.train(table.repartition(3), least=least) for least in (1, 2)}


@pytest.mark.parametrize("least", [1, 2])
def test_probabilities_are_those_of_the_formula(fitted, least):
    model = fitted[least]
    assert model.names == ["de", "en", "ja"]
    alphabet = len({s for texts in TEXTS.values() for t in texts for s in plain_symbols(t)}) + 1
    assert model.alphabet == alphabet
    probes = [language.symbols_of(t) for texts in TEXTS.values() for t in [*texts, "Zebra und the 日本 жук", "a"]]
    grams = language.five_grams(probes).symbols
    for j, name in enumerate(model.names):
        plain = Plain(TEXTS[name], alphabet, least)
        wanted = [math.log(plain.p(tuple(int(c) for c in gram))) for gram in grams]
        assert np.allclose(language.Reader(model).logp(j, grams), wanted, atol=1e-4)


def test_probabilities_after_a_context_add_up_to_one(fitted):
    model = fitted[2]
    symbols = sorted({s for texts in TEXTS.values() for t in texts for s in plain_symbols(t)} | {0x436})
    for context in ([0, 0, 0, 0], [0, ord("t"), ord("h"), ord("e")], [ord(c) for c in "zzzz"]):
        grams = np.array([[*context, s] for s in symbols], np.int32)
        for j in range(len(model.names)):
            assert abs(np.exp(language.Reader(model).logp(j, grams)).sum() - 1) < 1e-4


def test_symbols_are_those_of_plain_python():
    for text in ("", "...", " A b", "Ünï 99 ß!", "ab  cd", "日本 go", "\U0001d400 x\x00y", "İstanbul"):
        assert language.symbols_of(text).tolist() == plain_symbols(text)


def test_costs_do_not_depend_on_what_else_is_scored(fitted):
    texts = ["the dog", "", "und der Hund", "日本語", "the dog"] * 3
    together, n = language.Reader(fitted[1]).costs(texts)
    for text, costs, many in zip(texts, together, n, strict=True):
        alone, own = language.Reader(fitted[1]).costs([text])
        assert np.allclose(alone[0], costs) and own[0] == many == len(plain_symbols(text))


def test_long_texts_are_cut_between_words(fitted, monkeypatch):
    monkeypatch.setattr(language, "CHUNK", 50)
    text = "the dog and the cat " * 20
    assert "".join(language.chunks(text)) == text
    costs, n = language.Reader(fitted[1]).costs([text])
    assert n[0] == len(plain_symbols(text)) and costs[0].argmin() == 1


def test_unseen_texts_of_three_scripts_and_noise(spark):
    draw = random.Random(3)
    parts = {"el": "αβγδεηικλμνοπρστυω", "en": "abcdefghiklmnoprstuw", "pl": "aąbcćdeęiłnoóprsśtuwyz"}
    # words of two-letter syllables that differ from language to language
    syllables = {name: ["".join(draw.choices(letters, k=2)) for _ in range(60)] for name, letters in parts.items()}
    make = lambda name: " ".join("".join(draw.choices(syllables[name], k=draw.randint(1, 3))) for _ in range(60))
    rows = [(name, make(name)) for name in parts for _ in range(40)]
    model = language.train(spark.createDataFrame(rows, "lang string, text string"))
    unseen = [(name, make(name)) for name in parts for _ in range(20)]
    noise = [("und", "".join(draw.choices(parts["en"], k=6)) + " " + "".join(draw.choices(parts["en"], k=200))) for _ in range(10)]
    got = language.identify(spark.createDataFrame(unseen + noise, "want string, text string"), model).collect()
    assert all(r.language.lang == r.want and r.language.accepted and r.language.score > 0.5 for r in got if r.want != "und")
    assert not any(r.language.accepted for r in got if r.want == "und")


def test_a_task_holds_little_of_many_texts():
    draw = random.Random(3)
    words = ["".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(3000)]
    texts = [" ".join(draw.choices(words, k=5000)) for _ in range(60)]
    reader = language.Reader(language.LanguageModel(["xx"], files=[{}], alphabet=27))
    tracemalloc.start()
    try:
        costs, n = reader.costs(texts)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert n.tolist() == [len(t) + 1 for t in texts] and costs[:, 0] == pytest.approx(n * np.log(27))
    assert peak < 120e6


def test_counts_of_a_task_are_added_up(spark, monkeypatch):
    draw = random.Random(4)
    rows = [(("en", "de")[k % 2], " ".join(draw.choices(["ab", "bc", "cab"], k=300))) for k in range(40)]
    df = spark.createDataFrame(rows, "lang string, text string").coalesce(1)
    want = {tuple(r) for r in language.count_grams(df).collect()}
    monkeypatch.setattr(language, "AT_ONCE", 500)
    assert {tuple(r) for r in language.count_grams(df).collect()} == want
    monkeypatch.setattr(language, "GRAMS_HELD", 50)
    monkeypatch.setattr(language, "ROWS_OUT", 7)
    assert {tuple(r) for r in language.count_grams(df).collect()} == want
