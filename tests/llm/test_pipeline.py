from __future__ import annotations

from collections import Counter, defaultdict

import corpus_pipeline
import public_tokenizers
from tokenizers import Tokenizer

from tests.llm import plain_pii
from tests.llm.test_joins import plain_classes
from tests.llm.test_mixing_sharding_media import plain_targets
from tests.llm.test_pii_quality_url import plain_features
from tidemark.llm import common, registry


def test_stages_keep_the_columns_and_run_in_order(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "pii", "mixing", "packing"]
    counts = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        docs = common.cut(out)
        counts.append(docs.count())
    assert counts[0] >= counts[1] > counts[2] == counts[3]
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert last.count() > 0


def test_stages_take_odd_rows(spark, docs, no_docs, sf_dir):
    for rows in (docs, no_docs):
        now = rows
        for _, stage in corpus_pipeline.STAGES[:-1]:
            now = common.cut(stage(spark, now, sf_dir))
            assert now.columns == rows.columns
        assert (corpus_pipeline.STAGES[-1][1](spark, now, sf_dir).count() > 0) == (rows is docs)


def test_run_by_plain_versions_of_its_stages(spark, sf_dir):
    now = common.table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang", "n_chars")
    expected = {r["doc_id"]: (r["text"], r["source"]) for r in now.collect()}

    found = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = common.cut(stage(spark, now, sf_dir))
        found[name] = [(r["doc_id"], r["text"], r["source"]) for r in now.collect()]

    def fails(text):  # too few labels here to prove a cutoff, so the base limits decide
        n, _, _, _, repeated = plain_features(text)
        return n < 10 or 100 * repeated > 20 * n

    expected = {i: x for i, x in expected.items() if not fails(x[0])}
    assert sorted(found["quality_rules"]) == sorted((i, *x) for i, x in expected.items())
    ids = sorted(expected)
    _, group = plain_classes([expected[i][0] for i in ids])
    first = {g: min(i for i, h in zip(ids, group, strict=True) if h == g) for g in group}
    expected = {i: expected[i] for i in first.values()}
    assert sorted(found["near_duplicates"]) == sorted((i, *x) for i, x in expected.items())
    expected = {i: (plain_pii.rewritten(text)[0], source) for i, (text, source) in expected.items()}
    assert sorted(found["pii"]) == sorted((i, *x) for i, x in expected.items())

    copies = Counter(found["mixing"])
    assert set(copies) <= {(i, *x) for i, x in expected.items()} and max(copies.values()) <= 3
    sizes, taken, times = defaultdict(int), defaultdict(int), defaultdict(set)
    for i, (text, source) in expected.items():
        n = len(text.encode().split())
        sizes[source] += n
        taken[source] += n * copies[i, text, source]
        times[source].add(copies[i, text, source])
    wanted, longest = plain_targets(sizes), max(len(text.encode().split()) for text, _ in expected.values())
    assert all(abs(taken[s] - wanted[s]) <= longest and max(times[s]) - min(times[s]) <= 1 for s in sizes)

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    ids_of = {i: [*tokenizer.encode(text, add_special_tokens=False).ids, 0] for i, (text, _) in expected.items()}
    covered, sequences = Counter(), defaultdict(list)
    for r in corpus_pipeline.run(spark, sf_dir).collect():
        assert list(r["ids"]) == ids_of[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        covered.update((r["doc_id"], at) for at in range(r["start"], r["start"] + r["length"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert covered == Counter({(i, at): n for (i, *_), n in copies.items() for at in range(len(ids_of[i]))})
    for pieces in sequences.values():
        ends = [0]
        for offset, length in sorted(pieces):
            assert offset == ends[-1]
            ends.append(offset + length)
        assert ends[-1] <= 1024


def test_every_operator_is_registered():
    names = registry.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and set(registry.oracle_sql()) <= set(names)
