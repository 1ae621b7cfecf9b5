"""Cached token counts against the libraries themselves."""

import os

import pytest

from leaksift.llm import tokens

public_tokenizers = pytest.importorskip("public_tokenizers")
JSON, MODEL = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
TEXTS = [None, "", " ", "one two", "one two", "End <|endoftext|> here", "naïve Ünïcode 日本語 🙂", "\x00 a\r\n\tb", "z " * 3000, "<s>x</s>"]


def own(path, text):
    if path.endswith(".json"):
        from tokenizers import Tokenizer
        return len(Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids)
    from sentencepiece import SentencePieceProcessor
    return len(SentencePieceProcessor(model_file=path).encode(text or ""))


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def frame(spark, texts):
    return spark.createDataFrame([(i // 2, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, digest string, key int")


def want(path, texts):
    found = [(i // 2, len((t or "").encode()), own(path, t), own(path, t) > 1024) for i, t in enumerate(texts)]
    return sorted(found, key=repr)


@pytest.mark.parametrize("path", [JSON, MODEL])
def test_counts_equal_the_library(spark, tmp_path, path):
    docs = frame(spark, TEXTS)
    got = tokens.token_counts(docs, path, str(tmp_path))
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert rows(got) == want(path, TEXTS)


def test_only_missing_contents_are_encoded(spark, tmp_path, monkeypatch):
    asked, encode = [], tokens._encoded
    monkeypatch.setattr(tokens, "_encoded", lambda texts, *rest: (asked.append(texts.count()), encode(texts, *rest))[1])
    first = frame(spark, ["a b", "a b", "c", None, ""])
    assert rows(tokens.token_counts(first, JSON, str(tmp_path))) == want(JSON, ["a b", "a b", "c", None, ""])
    assert asked == [3]
    more = ["c", "new one", "new one", "a b"]
    assert rows(tokens.token_counts(frame(spark, more), JSON, str(tmp_path))) == want(JSON, more)
    assert asked == [3, 1]
    assert rows(tokens.token_counts(frame(spark, more), JSON, str(tmp_path))) == want(JSON, more)
    assert asked == [3, 1]
    # The other tokenizer has counts of its own.
    tokens.token_counts(frame(spark, more), MODEL, str(tmp_path)).collect()
    assert asked == [3, 1, 3] and len(os.listdir(tmp_path)) == 2


def test_rows_stored_twice_count_once(spark, tmp_path):
    texts = ["a b c", "d"]
    tokens.token_counts(frame(spark, texts), JSON, str(tmp_path)).collect()
    folder = next(tmp_path.iterdir())
    stored = spark.read.parquet(str(next(p for p in folder.iterdir())))
    stored.write.parquet(str(folder / "again"))
    assert rows(tokens.token_counts(frame(spark, texts), JSON, str(tmp_path))) == want(JSON, texts)


def test_many_missing_take_the_other_join(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tokens, "BROADCAST_ROWS", 4)
    texts = [f"text {i % 7}" for i in range(30)]
    assert rows(tokens.token_counts(frame(spark, texts), JSON, str(tmp_path))) == want(JSON, texts)


def test_empty_table_and_other_files(spark, tmp_path):
    assert rows(tokens.token_counts(frame(spark, ["x"]).where("false"), JSON, str(tmp_path))) == []
    other = tmp_path / "t.txt"
    other.write_text("x")
    with pytest.raises(ValueError):
        tokens.token_counts(frame(spark, ["x"]), str(other), str(tmp_path))
