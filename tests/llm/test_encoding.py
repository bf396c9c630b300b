"""Token counts and BPE against the tokenizers library."""

import json
import random
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from deskwise.llm import bpe, tokens
from deskwise.llm.vocab import load

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
EDGE = [
    "", "   ", "a", "ΑΣ ΟΔΟΣ", "İstanbul ǅ", "don't I'll we've 'tis 'r 're 'rx 'v've 'l 'll''ll 's's", "x\x1cy\x1f z", "\0 a\0b \0<|endoftext|>",
    "hi<|endoftext|>there <|startoftext|> x<|endoftext|>", "<|endoftext|", "é café é ́x", "½ 1234 ٣٤ Ⅷ", "日本語😀👍🏽", "a" * 3000,
    "ab" * 2000 + "!" * 500, " x　y​y\xa0", "a  b\n\nc \n d \t", " 's  'll\n're end'", "'", "'r", " '", "a\r\n\r\n  b", "ẞ ß ﬁ Å",
]


def noise(n):
    rng = random.Random(4)
    return ["".join(rng.choice("stmdrevl'' \n\tA1!éß.日S") for _ in range(rng.randrange(40))) for _ in range(n)]


def test_counts_equal_the_library():
    texts, reference = EDGE + noise(1500), Tokenizer.from_file(BYTES)
    sizes, counts = tokens.counter(BYTES).count([*texts, None])
    assert counts.tolist() == [len(reference.encode(t, add_special_tokens=False).ids) for t in texts] + [0]
    assert sizes.tolist() == [len(t.encode()) for t in texts] + [0]


def test_counts_do_not_depend_on_the_state_limit_or_the_chunk():
    small = tokens.Counter(load(BYTES))
    small.transducer.max_states = 50
    texts = EDGE + noise(200)
    whole = tokens.counter(BYTES).count(texts)[1]
    assert [int(small.count([t])[1][0]) for t in texts] == whole.tolist()
    kinds = np.array([random.Random(k).randrange(12) for k in range(5000)], np.uint8)
    kinds[-1] = tokens.END
    assert all((tokens.word_starts(kinds, c) == tokens.word_starts(kinds, 5000)).all() for c in (1, 7, 64))


def test_ids_and_decoding_equal_the_library():
    texts, reference = EDGE + noise(1500), Tokenizer.from_file(WORDS)
    coder = bpe.encoder(WORDS)
    flat, counts = coder.encode([*texts, None])
    decoded = coder.decode(flat, counts)
    at = 0
    for text, n, back in zip([*texts, ""], counts, decoded, strict=True):
        expect = reference.encode(text, add_special_tokens=False).ids
        assert flat[at : at + n].tolist() == expect
        assert back == reference.decode(expect, skip_special_tokens=False)
        at += n


@pytest.mark.parametrize("context", ["{}", "a{}b", "x{}1's {}\u0301"])
def test_every_code_point(context):
    texts = [context.replace("{}", chr(c)) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    coder, words, counter, counted = bpe.encoder(WORDS), Tokenizer.from_file(WORDS), tokens.counter(BYTES), Tokenizer.from_file(BYTES)
    step = 1 << 17
    for part in (texts[k : k + step] for k in range(0, len(texts), step)):
        flat, sizes = coder.encode(part)
        expect = [e.ids for e in words.encode_batch(part, add_special_tokens=False)]
        assert sizes.tolist() == list(map(len, expect)) and flat.tolist() == [i for ids in expect for i in ids]
        assert counter.count(part)[1].tolist() == [len(e.ids) for e in counted.encode_batch(part, add_special_tokens=False)]


def test_special_strings_of_any_look(tmp_path):
    for path in (BYTES, WORDS):
        content = json.loads(Path(path).read_text())
        like, top = content["added_tokens"][0], max(a["id"] for a in content["added_tokens"])
        top = max(top, *content["model"]["vocab"].values())
        content["added_tokens"] += [like | {"id": top + 1 + k, "content": c} for k, c in enumerate(("[CLS]", "@@end"))]
        file = tmp_path / Path(path).name
        file.write_text(json.dumps(content))
        vocab, reference, texts = load(str(file)), Tokenizer.from_file(str(file)), ["one [CLS]two@@end three", "x@@end", "plain"]
        expect = [reference.encode(t, add_special_tokens=False).ids for t in texts]
        if vocab.suffix:
            ids, sizes = bpe.Encoder(vocab).encode(texts)
            assert ids.tolist() == sum(expect, []) and sizes.tolist() == list(map(len, expect))
        else:
            assert tokens.Counter(vocab).count(texts)[1].tolist() == list(map(len, expect))


def test_unsupported_vocabularies_are_refused(tmp_path):
    with pytest.raises(ValueError):
        tokens.Counter(load(WORDS))


def test_spark_operators(spark, hostile, empty):
    rows = tokens.token_counts(hostile, BYTES).collect()
    assert len(rows) == hostile.count() and sum(r.n_tokens == 0 for r in rows) == 3
    coded = bpe.encode(hostile, WORDS, decoded=True)
    again = bpe.decode(coded.select("doc_id", "ids", F.col("decoded").alias("before")), WORDS)
    assert again.where("before != decoded").count() == 0 and coded.where("length(ids) != 4 * n_tokens").count() == 0
    assert bpe.encode(empty, WORDS).count() == tokens.token_counts(empty, BYTES).count() == 0
