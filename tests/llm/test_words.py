"""Words of the packing operator: encoded together, with the ids of the library."""

import numpy as np
import pyarrow as pa
import public_tokenizers as P
from tokenizers import Tokenizer

from treeline.llm import packing

PATH = P.path("word_bpe_49k.json")
ODD = ["", None, "~", "a~b ~ c~~", "ab~. ~~x", "<|startoftext|> a~", "H\u0331 \u0331x ~ \u0331 ~\u0303", "\u0130stanbul I\u0307", "a \x85 b \x85", "\x85", "\u2003 \x85", "don't l'\u00e9t\u00e9's 12ab 3.5", "\u00dcber-\u00c4\u00d6, \u00e9\u00e1 \u00b5m \u00aa\u00ba", "\u03a3\u03b1\u03c2 \u03a3\u0391\u03a3.", "STRA\u1e9eE stra\u00dfe \u00ff"]


class Counting:
    """A tokeniser that counts the texts it is given."""

    def __init__(self, inner):
        self.inner, self.texts = inner, 0

    def __getattr__(self, name):
        return getattr(self.inner, name)

    def encode_batch_fast(self, texts, **how):
        self.texts += len(texts)
        return self.inner.encode_batch_fast(texts, **how)


def test_new_words_are_encoded_together():
    model, encoder = Tokenizer.from_file(PATH), packing.WordEncoder(PATH)
    encoder.model = Counting(encoder.model)
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("abcdeioß1é."), 7)) for _ in range(3_000)]
    texts = [*ODD, " ".join(words), " ".join(words[::-1])]
    flat, ends = encoder.encode(pa.array(texts))
    assert [flat[a:z].tolist() for a, z in zip(ends, ends[1:], strict=False)] == [model.encode(t or "", add_special_tokens=False).ids + [0] for t in texts]
    assert encoder.model.texts < 100


def test_classes_are_told_without_a_python_word():
    """Words of an Arrow array have the classes of their letters by hand, whatever their kind of string."""
    from treeline.llm import language_model
    from treeline.llm.common import hash64

    words = ["", "the", "of", "x", "\u00dfe", "tion", "the\u00e9", "\U0001f600", "a\U0001f600", "of "]
    classes = language_model.Classes(["the", "of"])
    want = [{"": 0, "the": 1, "of": 2}.get(w, 3 + int(hash64([w[-language_model.LETTERS :]], seed=5)[0] % np.uint64(language_model.ENDINGS))) for w in words]
    for kind in (pa.string(), pa.large_string()):
        assert classes.of(pa.array(words, kind)).tolist() == want
    assert classes.of([]).tolist() == [] and classes.of(words).tolist() == want
    found, codes, ends = language_model.tokens(pa.array(["The of THE", None, ""]))
    assert isinstance(found, pa.Array) and [found[int(c)].as_py() for c in codes] == ["the", "of", "the", "", "", ""] and ends.tolist() == [0, 4, 5, 6]


def test_a_worker_remembers_half_at_most_between_partitions(monkeypatch):
    monkeypatch.setattr(packing, "CACHE", 200)
    monkeypatch.setattr(packing, "WORDS", 400)
    encoder = packing.WordEncoder(PATH)
    texts = [pa.array([" ".join(f"wort{i}x{k}" for i in range(150))]) for k in range(6)]
    first = [encoder.encode(t)[0].tolist() for t in texts]
    assert encoder.whole.old and encoder.seen.old
    encoder.rest()
    assert not encoder.whole.old and not encoder.seen.old
    assert [encoder.encode(t)[0].tolist() for t in texts] == first


def test_words_are_hashed_together():
    """All lengths, those of the library's long way too, of slices and of both kinds of string."""
    from treeline.llm.common import hash64, hash_words, listed

    rng = np.random.default_rng(5)
    words = ["", *("".join(rng.choice(list("abcß1é.\U0001f600"), n)) for n in range(1, 60) for _ in range(5))]
    for seed in (0, 1, 1 << 40):
        for kind in (pa.string(), pa.large_string()):
            given = pa.array(words, kind)
            assert (hash_words(given, seed) == hash64(words, seed)).all() and (hash_words(given[7:40], seed) == hash64(words[7:40], seed)).all()
    assert len(hash_words(pa.array([], pa.string()))) == 0 and listed(pa.array([], pa.string())) == []
    assert listed(pa.array(words)) == words and listed(pa.array(["", ""])) == ["", ""]


def test_toxicity_words_as_python_has_them():
    from treeline.llm import toxicity
    from treeline.llm.common import hash64

    words = ["\u0391\u03a3.", "\u03a3", "\u0130x", "\u00abHaus\u00bb", "(\u00dcBER)", "'tis", "!!", "\u2026", "d\u00e9j\u00e0-vu", "IDIOT!", "ma\u00f1a\u00f1a", "a\x85b"]
    kinds, codes, _ = toxicity.Lexicon().buckets(pa.array([" ".join(words)]))
    plain = ["".join(c.lower() if c.isascii() else c for c in w).strip(toxicity.STRIP).lower() for w in words]
    cut = [w[: toxicity.PREFIX] if len(w) >= toxicity.PREFIX else "" for w in plain]
    want = [[int(hash64([w], s)[0] >> np.uint64(64 - toxicity.BITS)) if w else 0 for s, w in enumerate(x)] for x in zip(plain, cut)]
    assert kinds[codes].tolist() == want


def test_pooling_takes_the_first_of_equals():
    from treeline.llm import toxicity

    columns = toxicity.FILTERS * len(toxicity.WIDTHS)
    value = np.tile(np.array([1, 3, 3, 3, 3, 2, 5, 0, 0], np.float32), (columns, 1))
    top, where = toxicity.Network.pool(value, np.array([0, 6]))
    assert top[:, 0, 0].tolist() == [3, 3, 3] and where[:, 0, 0].tolist() == [1, 2, 3]
    assert top[:, 1, -1].tolist() == [5, 0, 0] and where[:, 1, -1].tolist() == [6, 7, 8]


def test_new_words_take_little_memory():
    """Texts of nothing but new words: what a worker holds at most, arrays included."""
    import inspect
    import tracemalloc

    from treeline.llm.common import slices

    texts = pa.array([" ".join(f"q{i}w{k}e" for i in range(10_000)) for k in range(60)])
    batch = pa.record_batch([texts], ["text"])
    encoder = packing.WordEncoder(PATH)
    most = inspect.signature(packing.pieces).parameters.get("batch")
    tracemalloc.start()
    for b in slices(iter([batch]), "text", most.default if most else 2 << 20):
        encoder.encode(b.column("text"))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 90e6, peak
