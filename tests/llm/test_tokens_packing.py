from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm import packing, tokens
from tidemark.llm.tokenizer import encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def whole():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=" \n\t\r\x0b\x1c\x85 　'ab1.é漢\U0001f600st", max_size=40), st.sampled_from(["<|endoftext|>", " it's  we'll ", "a  b   c "])), max_size=6))
def test_chunked_ids_are_the_tokenizers(texts):
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    ids, at = encoder(PATH).encode_many(pa.array(texts, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def test_histogram_and_sums(spark, docs, rows, no_docs, whole):
    lengths = Counter(len(whole(r[1])) for r in rows)
    hist = tokens.histogram(tokens.token_lengths(docs, PATH))
    assert {r["n_tokens"]: r["n_docs"] for r in hist.collect()} == lengths
    every = sorted(lengths.elements())
    for r in tokens.suffix_sums(hist).collect():
        n = r["n_tokens"]
        at_least = [x for x in every if x >= n]
        assert (r["docs_at_least"], r["tokens_at_least"], r["docs_below"]) == (len(at_least), sum(at_least), len(every) - len(at_least))
        assert r["tokens_if_cut"] == sum(min(x, n) for x in every) and r["docs_up_to"] == sum(x <= n for x in every)
    for r in tokens.totals(hist, [0, 7, 512]).collect():
        assert (r["docs_over"], r["tokens_if_cut"], r["tokens_lost"]) == (sum(x > r["limit"] for x in every), sum(min(x, r["limit"]) for x in every), sum(max(0, x - r["limit"]) for x in every))
    found = {r["share"]: r["n_tokens"] for r in tokens.quantiles(tokens.suffix_sums(hist), [0.1, 0.5, 1.0]).collect()}
    assert found == {q: every[int(np.ceil(q * len(every))) - 1] for q in found} and len(found) == 3
    assert tokens.suffix_sums(tokens.histogram(tokens.token_lengths(no_docs, PATH))).count() == 0


def test_packed_pieces_tile_documents_and_sequences(docs, rows, no_docs, whole):
    found = packing.pack(docs, PATH, with_ids=True).collect()
    sequences, pieces = {}, Counter()
    for r in found:
        assert r["length"] == len(r["ids"]) > 0 and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        sequences.setdefault(r["sequence_id"], []).append(r)
        pieces[(r["doc_id"], r["doc_tokens"], r["start"], tuple(r["ids"]))] += 1
    padding = 0
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    documents = Counter()
    for r in rows:
        documents[(r[0], tuple([*whole(r[1]), 0]))] += 1
    rebuilt = Counter()
    for (doc, ids), n in documents.items():
        at, cut = 0, []
        while at < len(ids):
            piece = next(p for p in pieces if p[:3] == (doc, len(ids), at) and ids[at : at + len(p[3])] == p[3] and pieces[p] >= n)
            cut.append(piece)
            at += len(piece[3])
        rebuilt.update(dict.fromkeys(cut, n))
    assert rebuilt == pieces
    total = sum(r["length"] for r in found)
    assert padding < 0.05 * total + 3 * 1024
    assert packing.pack(no_docs, PATH).count() == 0


def plain_cost(at, cost, window):
    best = [0] + [None] * (len(at) - 1)
    for j in range(1, len(at)):
        for i in range(j):
            size = at[j] - at[i]
            if size <= window:
                pad = 0 if size in packing.POWERS and size < window else window - size
                value = best[i] + pad + packing.ONE_MORE + cost[j]
                if best[j] is None or value < best[j]:
                    best[j] = value
    return best[-1]


@pytest.mark.parametrize("seed", range(8))
def test_cuts_cost_no_more_than_any_other(seed):
    rng = random.Random(seed)
    window = rng.choice([64, 256, 1024])
    at = np.array([0, *sorted(rng.sample(range(1, 4000), 300)), 4000])
    gaps = np.diff(at)
    at = np.unique(np.concatenate([at, *(np.arange(a, a + g, 50) for a, g in zip(at, gaps, strict=False) if g > window)]))
    cost = np.array([rng.choice([0, 8, 48]) for _ in at])
    cuts = packing.best_cuts(at, cost, window)
    value, before = 0, 0
    for j in cuts:
        size = int(at[j] - at[before])
        assert 0 < size <= window
        value += (0 if size in packing.POWERS and size < window else window - size) + packing.ONE_MORE + int(cost[j])
        before = j
    assert cuts[-1] == len(at) - 1 and value == plain_cost(at.tolist(), cost.tolist(), window)


def test_a_small_buffer_gives_whole_pieces(monkeypatch):
    packer = packing.Packer(PATH, 128, 0, 0, True)
    out, total = [], 0
    for k in range(6):
        texts = pa.array([f"Sentence {k} {i}. Another one, longer than that." * (i + 1) for i in range(20)])
        packer.add(list(range(20 * k, 20 * k + 20)), texts)
        total += int(packer.sizes[-20:].sum())
        out.append(packer.pack(last=k == 5))
    rows = [r for b in out if b is not None for r in b.to_pylist()]
    assert sum(r["length"] for r in rows) == total and {r["sequence_id"] for r in rows} == set(range(max(r["sequence_id"] for r in rows) + 1))
    for doc in range(120):
        mine = sorted((r for r in rows if r["doc_id"] == doc), key=lambda r: r["start"])
        assert [r["start"] for r in mine] == [sum(x["length"] for x in mine[:i]) for i in range(len(mine))] and sum(r["length"] for r in mine) == mine[0]["doc_tokens"]
