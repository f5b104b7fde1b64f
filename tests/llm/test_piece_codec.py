import re

import numpy as np
import public_tokenizers
import sentencepiece
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from gleaner.llm import piece_codec, tokens
from gleaner.llm.piece_codec import Codec

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
PLAIN, DROPPED, OTHER = Codec(PATH, 0.0), Codec(PATH, 0.1), Codec(PATH, 0.1, seed=5)
PARTS = st.sampled_from([" ", "   ", "\n", "\t", "hello", "The", "unbelievable", "'s", "12.5", "é", "日本語", "\x00", "🙂", "y" * 90, "internationalisation"])
TEXTS = st.one_of(st.lists(PARTS, max_size=15).map("".join), st.text(max_size=40).map(lambda t: t.replace("▁", "")))


def ids(codec, text):
    return np.frombuffer(codec.encode(text), "<u4").tolist()


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_without_dropout_equals_the_library(text):
    assert ids(PLAIN, text) == LIBRARY.encode(text)


@settings(max_examples=300, deadline=None)
@given(st.one_of(TEXTS, st.text(alphabet="▁ a\n", max_size=20)))
def test_decodes_losslessly(text):
    for codec in (PLAIN, DROPPED, OTHER):
        assert codec.decode(codec.encode(text)) == text


def test_dropout_varies_by_seed_and_not_by_time():
    text = " ".join(f"internationalisation{a}of{b}unbelievable responsibilities{a}{b}" for a in "abcdef" for b in "uvwxyz")
    assert DROPPED.encode(text) == Codec(PATH, 0.1).encode(text)
    assert len({c.encode(text) for c in (PLAIN, DROPPED, OTHER)}) == 3
    assert len(DROPPED.encode(text)) > len(PLAIN.encode(text))


def test_dropout_varies_by_document_and_place():
    word = "internationalisation"
    alone = {tuple(ids(DROPPED, f"{word}\n{k}")).index(ids(PLAIN, "\n")[-1]) for k in range(200)}
    texts = [ids(DROPPED, " ".join([word] * 200) + f" {k}") for k in range(3)]
    assert len(alone) > 2  # several segmentations of one unit, by document
    assert len({tuple(t) for t in texts}) == 3
    # a unit's occurrences in one text are cut in several ways
    starts = [i for i, p in enumerate(texts[0]) if LIBRARY.id_to_piece(p).startswith("▁")]
    assert len({tuple(texts[0][a:b]) for a, b in zip(starts, starts[1:], strict=False)}) > 2


def test_draws_agree_and_skip_a_tenth_whatever_the_memo():
    unit, nth = np.repeat(np.arange(400), 50), np.tile(np.arange(50), 400)
    drawn = piece_codec._all_drawn(np.uint64(12345678901234567890), unit, nth)
    assert drawn.tolist() == [piece_codec.drawn(12345678901234567890, u, n) for u, n in zip(unit.tolist(), nth.tolist(), strict=True)]
    assert abs((drawn < int(0.1 * (1 << 32))).mean() - 0.1) < 0.01
    texts = [f"responsibilities unbelievable {k} internationalisation understanding responsibilities" for k in range(300)]
    warm = [DROPPED.encode(t) for t in texts]
    assert warm == [DROPPED.encode(t) for t in texts] and warm[::-1] == [c.encode(t) for c in [Codec(PATH, 0.1)] for t in texts[::-1]]


def naive(codec, text):
    """The agenda by looking at all neighbours again and again; a skipped pair is dead as long as both its symbols stand."""
    out, key = [], xxhash.xxh64_intdigest(text.encode(), seed=codec.seed)
    for place, unit in enumerate(re.findall(r" *[^ \n]+|\n| +", " " + text)):
        symbols = [("\0▁" if c == "▁" else "▁" if c == " " else c, i) for i, c in enumerate(unit)]
        dead, taken = set(), 0
        while True:
            near = [(codec.rank[a + b], i, k) for k, ((a, i), (b, _)) in enumerate(zip(symbols, symbols[1:], strict=False)) if a + b in codec.rank and (i, a, b) not in dead]
            if not near:
                break
            _, i, k = min(near)
            a, b = symbols[k][0], symbols[k + 1][0]
            if piece_codec.drawn(key, place, taken) < codec.limit:
                dead.add((i, a, b))
            else:
                symbols[k : k + 2] = [(a + b, i)]
            taken += 1
        for p, _ in symbols:
            out += [codec.ids[p]] if p in codec.ids else [codec.bytes[b] for b in ("▁" if p == "\0▁" else p).encode()]
    return out


@settings(max_examples=200, deadline=None)
@given(st.one_of(TEXTS, st.text(alphabet="▁ a\nbcde", max_size=60)))
def test_dropout_equals_a_naive_agenda(text):
    want = naive(DROPPED, text) if text else []
    assert ids(DROPPED, text) == want
    flat, counts = DROPPED.arrays([text, "", "between", text])  # beside others, a text has the same ids
    assert counts[1] == 0 and flat[: counts[0]].tolist() == flat[len(flat) - counts[3] :].tolist() == want


def test_small_memo_and_long_units(monkeypatch):
    monkeypatch.setattr(tokens, "SLOTS", 32)
    monkeypatch.setattr(piece_codec, "LONGEST", 6)
    small = Codec(PATH, 0.1)
    for k in range(40):
        text = f"of the {k} internationalisation a b c {'word' * (k % 5)} understanding"
        assert small.encode(text) == DROPPED.encode(text)
