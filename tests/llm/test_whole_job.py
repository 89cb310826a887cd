"""What earlier rounds left out: small sources, copies as pages, marker texts."""

import random
import zlib

import corpus_pipeline as P
import numpy as np
import public_tokenizers as V
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from spanledger.llm import token_files as T
from spanledger.llm.arrays import texts_of
from spanledger.llm.packing import token_pieces
from spanledger.llm.pretokens import library_encoder

from brute import DOC


def documents(sp, own):
    return sp.createDataFrame([(i, t, "en", s, len(t)) for i, (t, s) in enumerate(own)], DOC)


def test_small_sources_lose_their_lines_too(sp):
    own = [(f"menu\nown {s} {i}\nfoot {s}", f"s{s}") for s in (1, 2, 3, 5, 19) for i in range(s)]
    own += [(f"rare {i // 2}\nown 8 {i}", "s8") for i in range(8)]
    left = {r.doc_id: r.text for r in P.drop_site_lines(sp, documents(sp, own), "").collect()}
    for i, (text, source) in enumerate(own):
        # One page says nothing about its site; two of eight pages are under the ratio.
        assert left[i] == (text if source in ("s1", "s8") else text.split("\n")[1])


def test_a_group_of_copies_keeps_one_document(sp):
    rng = random.Random(4)
    text = lambda: "\n".join(" ".join(f"w{rng.randrange(5000)}" for _ in range(20)) for _ in range(4))
    spread, inside = text(), text()
    own = [(spread if i % 3 == 0 else f"menu\n{text()}", f"s{i % 4}") for i in range(240)]
    own += [(inside if i % 2 else f"menu\n{text()}", "s9") for i in range(30)]
    lines = P.drop_site_lines(sp, documents(sp, own), "").cache()
    assert all(r.text for r in lines.collect()) and not any("menu" in r.text for r in lines.collect())
    left = [r.text for r in P.keep_one_of_each(sp, lines, "").collect()]
    assert left.count(spread) == left.count(inside) == 1
    assert len(left) == sum(t not in (spread, inside) for t, _ in own) + 2


MARKERS = ["a<|endoftext|>b", "<|endoftext|>", "x <|startoftext|> Y'<|endoftext|>s 12<|endoftext|><|endoftext|>", "<|ENDOFTEXT|> <|endoftext|", "É<|endoftext|>\u0338 z", "plain", "",
           "<<|endoftext|>|>  \n<|startoftext|>\n"]


@pytest.mark.parametrize(("name", "lower"), [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
def test_added_tokens_as_the_library_by_default(name, lower):
    texts = MARKERS + ["".join(random.Random(i).choice(["<|endoftext|>", "<|startoftext|>", " ", "Ab", "'s", "1", "\n"]) for _ in range(9)) for i in range(300)]
    want = [e.ids for e in Tokenizer.from_file(V.path(name)).encode_batch(texts, add_special_tokens=False)]
    for own, ids_ in ((texts, want), (texts[5:7], want[5:7]), (texts[:1], want[:1])):
        ids, at = library_encoder(V.path(name), lower, added=True).ids(texts_of(pa.array(own)))
        assert ids.dtype == np.uint32 and [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == ids_


def test_pieces_and_files_hold_added_tokens(sp, tmp_path):
    docs = documents(sp, [(t, "s") for t in MARKERS])
    for name, end, out in (("byte_bpe_50k.json", 0, lambda p: token_pieces(docs, p, 0)),
                           ("word_bpe_49k.json", 1, lambda p: T.read_token_files(sp, T.write_token_files(docs, str(tmp_path / "ids"), p, 1)))):
        tok, got = Tokenizer.from_file(V.path(name)), {r.doc_id: r.ids_crc32 for r in out(V.path(name)).collect()}
        assert got == {i: zlib.crc32(np.array([*tok.encode(t, add_special_tokens=False).ids, end], "<u4").tobytes()) for i, t in enumerate(MARKERS)}
