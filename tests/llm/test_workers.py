import gc
import itertools
import weakref

import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from quarryline.llm import common, exact_dedup, language, near_dedup, packing

BATCH = pa.RecordBatch.from_pydict({"row_id": [1, 2], "doc_id": [1, 2], "text": ["one two three", None]})


class Table:
    """Stands for a table and gives the function that its tasks would run."""

    def __init__(self, spark):
        self.sparkSession, self.schema, self.run = spark, None, None

    def select(self, *columns):
        return self

    groupBy = agg = select

    def mapInArrow(self, run, schema):
        self.run = run
        return self


def near(table, monkeypatch):
    def stop(*a):
        raise InterruptedError

    monkeypatch.setattr(near_dedup, "written", stop)
    with pytest.raises(InterruptedError):
        near_dedup.near_groups(table)


OTHERS = {
    "language_id": (["doc_id", "text"], lambda table, m: language.accepted(table, None, 0.3)),
    "recipes": (["row_id", "doc_id", "text"], lambda table, m: exact_dedup.recipes(table)),
    "chunks": (["text"], lambda table, m: exact_dedup.chunk_table(table)),
    "near_dedup": (["row_id", "doc_id", "text"], near),
}


@pytest.mark.parametrize("name", OTHERS)
def test_workers_forget_the_packing_tokenizer_before_other_work(spark, monkeypatch, name):
    """A worker that packed once held some hundred MB of words, beside an executor that has grown, as long as it lived."""
    packs, other = Table(spark), Table(spark)
    packing.packed(packs)
    columns, make = OTHERS[name]
    make(other, monkeypatch)
    list(packs.run(iter([BATCH.select(["doc_id", "text"])])))
    tokenizer = weakref.ref(packing.tokenizer("word_bpe_49k.json"))
    list(packs.run(iter([BATCH.select(["doc_id", "text"])])))
    assert tokenizer() is packing.tokenizer("word_bpe_49k.json") and "three" in tokenizer().known  # kept from task to task
    list(other.run(iter([BATCH.select(columns)])))
    gc.collect()
    assert tokenizer() is None


def test_tasks_give_memory_back(spark, monkeypatch):
    given = []
    monkeypatch.setattr(common, "give_back", lambda: given.append(1))
    run = common.lean(lambda batches: (b for b in batches), holds=True)
    assert list(run(iter("ab"))) == ["a", "b"] and len(given) == 1
    left_early = run(iter("ab"))
    next(left_early)
    left_early.close()
    assert len(given) == 2
    monkeypatch.setattr(near_dedup, "give_back", lambda: given.append(1))
    monkeypatch.setattr(near_dedup, "_rest", lambda key, table: table)
    assert near_dedup._rest_alone(None, "t") == "t" and len(given) == 3


def test_the_pipeline_packs_in_bounded_memory(spark):
    """Its workers remembered a million words; two of them, beside the JVM that the earlier stages had grown, took over 3000 MB."""
    words = ["".join(w) for w in itertools.islice(itertools.product("aeiknorst", repeat=5), 0, 59_000)]
    texts = [" ".join(words[i : i + 500]) for i in range(0, len(words), 500)]
    texts.append(texts[0])  # its words have been forgotten by then
    table = Table(spark)
    corpus_pipeline.packing(spark, table, "")
    most, ids = 0, {}
    for out in table.run(iter([pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})])):
        (tokenizer,) = common._held.values()
        most = max(most, len(tokenizer.known))
        for doc, part in zip(out.column(0).to_pylist(), out.column(3).to_pylist()):
            ids[doc] = ids.get(doc, b"") + part
    assert most <= corpus_pipeline.REMEMBERED < len(words)
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for i in (0, 1, 60, len(texts) - 2, len(texts) - 1):
        assert memoryview(ids[i]).cast("I").tolist() == [*whole.encode(texts[i], add_special_tokens=False).ids, 1]
