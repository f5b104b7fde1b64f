import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gleaner.llm.tokens import Ids

FILES = ("byte_bpe_50k.json", "word_bpe_49k.json")
_ids = {n: Ids(public_tokenizers.path(n)) for n in FILES}
PARTS = st.sampled_from([" ", "  ", "\n", "\n\n", "\t", "\r\n", "\x00", "\x1c", "\xa0", "　", "a", "The", "don't", "'s", "12", "3.5", "é", "e", "́", "Σας", "ΑΣ", "İ", "K", "<|endoftext|>", "<|ENDOFTEXT|>", "<|", ",", "--", "word", "y" * 80, "日本"])


@pytest.mark.parametrize("name", FILES)
@settings(max_examples=400, deadline=None)
@given(texts=st.lists(st.one_of(st.lists(PARTS, max_size=12).map("".join), st.text(max_size=30)), max_size=6))
def test_memo_changes_no_id(name, texts):
    assert _ids[name](texts) == _ids[name].whole(texts)


@pytest.mark.parametrize("name", FILES)
def test_memo_stays_bounded(monkeypatch, name):
    monkeypatch.setattr("gleaner.llm.tokens.SLOTS", 64)
    ids = Ids(public_tokenizers.path(name))
    texts = [f"word{i} other{i % 3} the, {'y' * (i % 90)}" for i in range(200)]
    for i in range(0, 200, 5):
        assert ids(texts[i : i + 5]) == ids.whole(texts[i : i + 5])
        assert ids.memo.entries <= 64 and (ids.memo.one > 0).sum() == ids.memo.entries


@pytest.mark.parametrize("name", FILES)
def test_texts_and_words_longer_than_a_chunk(monkeypatch, name):
    monkeypatch.setattr("gleaner.llm.tokens.CHUNK", 100)
    ids = Ids(public_tokenizers.path(name))
    texts = ["a bc  def\n" * 60, "x" * 350, " " * 230 + "y" * 230 + " z", "short", "", "a\u00a0b " * 40, "é" * 120 + " " * 5]
    assert ids(texts) == ids.whole(texts)


def test_other_tokenizers_are_asked_for_whole_texts(tmp_path):
    import json

    with open(public_tokenizers.path(FILES[0])) as f:
        settings_of = json.load(f)
    settings_of["pre_tokenizer"]["use_regex"] = False
    (tmp_path / FILES[1]).write_text(json.dumps(settings_of))  # the name of a file says nothing
    ids = Ids(str(tmp_path / FILES[1]))
    assert ids.kind is None and ids(["of the", "of the one"]) == ids.whole(["of the", "of the one"])
