import base64
import hashlib
import os
import random
from collections import Counter, defaultdict

import pytest

from casegraph.llm import token_alignment

pytestmark = pytest.mark.skipif(not os.path.isdir(token_alignment.FOLDER), reason="the vocabulary files are not here")
WORDS = "the Straße encoder tokenisation naïve 漢字 x1 <|endoftext|> <s> don't 1234567 zzzzqq \t \n\n ▁ 👍🏽 é ½ token of and".split(" ")


def texts(seed=3):
    rng = random.Random(seed)
    made = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 40))) for _ in range(60)]
    return [None, "", " ", "  two  spaces ", "\n", "a", "the the the", "x▁y", "long " * 3000, *made, made[0], made[0]]


def encoders():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(f"{token_alignment.FOLDER}/{token_alignment.BYTE_BPE}")
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=f"{token_alignment.FOLDER}/{token_alignment.PIECE_BPE}")
    # The same vocabulary as ranks gives the bytes of A's ids without undoing their spelling.
    with open(f"{token_alignment.FOLDER}/byte_bpe_50k.tiktoken", "rb") as f:
        bytes_a = {int(i): base64.b64decode(t) for t, i in map(bytes.split, f)}
    return a, b, bytes_a


def brute(rows):
    """Groups and links by walking along both token sequences, pair counts in one table, nothing counted apart."""
    a, b, bytes_a = encoders()
    links, docs = Counter(), []
    for doc_id, text in rows:
        groups, mine = [], []
        if text:
            ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            tokens_a = [bytes_a.get(i, b"\xff") for i in ids_a]
            tokens_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
            if b"".join(tokens_a) == b"".join(tokens_b) == (" " + text).encode():
                i = j = size_a = size_b = 0
                now_a, now_b = [], []
                while i < len(ids_a) or j < len(ids_b):
                    if size_a <= size_b:
                        size_a += len(tokens_a[i])
                        now_a.append(ids_a[i])
                        i += 1
                    else:
                        size_b += len(tokens_b[j])
                        now_b.append(ids_b[j])
                        j += 1
                    if size_a == size_b:
                        groups.append((now_a, now_b))
                        mine.append((now_a[-1], now_b[-1]))
                        now_a, now_b = [], []
        links.update(mine)
        docs.append((doc_id, groups, mine))
    best = defaultdict(int)
    for (_, y), n in links.items():
        best[y] = max(best[y], n)
    out = []
    for doc_id, groups, mine in docs:
        told = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((
            doc_id, sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), len(mine),
            sum(links[p] == best[p[1]] for p in mine), sum(links[p] for p in mine), hashlib.sha256(told.encode()).hexdigest() if groups else "",
        ))
    return sorted(out, key=str)


@pytest.mark.parametrize("top", [0, 3, 1 << 16])
def test_alignment_is_that_of_a_plain_walk(documents, top):
    rows = [(i if i % 7 else None, t, "s") for i, t in enumerate(texts())]
    got = token_alignment.alignments(documents(rows).repartition(3), top=top).collect()
    assert sorted(map(tuple, got), key=str) == brute([(i, t) for i, t, _ in rows])
    assert any(r.n_links > r.n_best > 0 for r in got)


def test_texts_not_given_back_have_no_tokens(documents):
    got = token_alignment.alignments(documents([(1, "x▁y", "s"), (2, None, None), (3, "", "s")])).collect()
    assert {tuple(r)[1:] for r in got} == {(0, 0, 0, 0, 0, 0, "")}


def test_empty_table(documents):
    assert token_alignment.alignments(documents([(1, "a", "s")]).limit(0)).count() == 0


def test_identity_array_pairs_equal_bytes():
    v = token_alignment.load(token_alignment.FOLDER)
    paired = [(i, int(j)) for i, j in enumerate(v.same) if j >= 0]
    assert len(paired) > 10_000
    assert all(v.bytes_a[i] == v.bytes_b[j] for i, j in paired)
