"""Encoding of many texts side by side is that of the tokenizers library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from tessera.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


class _Shared:
    def __init__(self, value):
        self.value = value


def test_texts_side_by_side_as_the_library_encodes_them():
    """Special strings only as they are written: in capitals they are words."""
    texts = [
        "", None, "  ", "<|ENDOFTEXT|>", "a<|EndOfText|> b<|endoftext|>c <|startoftext|>", "S<|endoftext|> s", "Wide　white\x85space\xa0\x1cΣΑΣ don't 12ab", "\U0001fae9 new ͸ x", "tok\x1f\x1een", "x" * 200 + " é" * 60,
    ]
    library = Tokenizer.from_file(PATH)
    lexicon = bpe.compile_lexicon(["don", "white"], [bpe.merges_of(PATH).merge(w) for w in ("don", "white")])
    batch = pa.record_batch({"doc_id": pa.array(range(len(texts))), "text": pa.array(texts)})
    want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    digests = [r for out in bpe._encode_batches(PATH, _Shared(lexicon), True)(iter([batch])) for r in out.to_pylist()]
    assert [r["__n"] for r in digests] == [len(x) for x in want]
    assert [r["__ids"] for r in digests] == [sha(" ".join(map(str, x))) for x in want]
    assert [r["__back"] for r in digests] == [sha(library.decode(x, skip_special_tokens=False)) for x in want]
    assert [r["__ids"] for out in bpe._encode_batches(PATH, _Shared(lexicon), False)(iter([batch])) for r in out.to_pylist()] == want


def test_words_merge_side_by_side_as_one_by_one():
    merges, rng = bpe.merges_of(PATH), random.Random(3)
    words = ["a", "the", "internationalization", "aaaaaaaa", "ééé", "日本語", *("".join(rng.choices("etaoinsr", k=rng.randint(1, 60))) for _ in range(400))]
    assert [np.frombuffer(x, np.int32).tolist() for x in merges.merge_all(words)] == [merges.merge(w) for w in words]
    assert merges.merge_all([]) == []
