import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from venuegrid.llm import decontamination
from venuegrid.llm.decontamination import Templates, contaminated, decontaminate
from document_tables import docs  # noqa: F401

ITEM = "Anna buys 12 apples and 5 pears at 3 dollars each. How much does Anna pay for the apples and the pears together?"
SAME = "Tom buys 40 apples and 9 pears at 2 euros each. How much does Tom pay for the apples and the pears together?"
MIXED = "Anna buys 12 apples and 5 pears at 3 dollars each. How much does Paul pay for the apples and the pears together?"


@pytest.fixture
def items(spark):
    rng = random.Random(1)
    texts = [" ".join(f"w{rng.randrange(900)}" + rng.choice(["", "", ",", "."]) for _ in range(rng.randint(15, 50))) for _ in range(20)]
    rows = [*enumerate(texts), (50, ITEM), (51, "what is two plus"), (52, "too short"), (53, None), (54, ""), (None, ITEM)]
    return spark.createDataFrame([(i, t, "x") for i, t in rows], "item_id long, text string, doc_id string")


def pairs(df):
    return {(r["doc_id"], r["item_id"]) for r in df.collect()}


def test_leaks_are_found_and_clean_documents_are_not(docs, items):
    rng = random.Random(2)
    texts = {r["item_id"]: r["text"] for r in items.collect() if r["item_id"] is not None and r["item_id"] < 20}
    noise = lambda n: " ".join(f"n{rng.randrange(9999)}" for _ in range(n))
    rows = [(i, noise(rng.randint(0, 300))) for i in range(100)]
    want = set()
    for k, text in texts.items():
        rows.append((1000 + k, f"{noise(40)}. {text} {noise(60)}"))
        want.add((1000 + k, k))
    rows += [(2000 + k, noise(20) + " " + " ".join(t.split()[:5])) for k, t in texts.items()]
    rows += [(3000, None), (3001, ""), (3002, noise(60_000) + " . " + texts[3]), (3003, texts[4]), (3003, texts[4]), (None, texts[5])]
    want |= {(3002, 3), (3003, 4), (None, 5)}
    assert pairs(contaminated(docs(rows, extra=True).repartition(4), items)) == want
    kept = decontaminate(docs(rows, extra=True), items)
    bad = {d for d, _ in want}
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(i) for i, _ in rows if i not in bad)
    assert kept.columns == docs(rows, extra=True).columns


def test_other_parameters(docs, items):
    vague = "Tom buys 4 apples and 9 pears at 7 euros each. How many pears does Anna and then Bob and Tom eat?"
    got = {r["doc_id"]: r for r in contaminated(docs([(1, SAME), (2, "Intro words. " + SAME.upper()), (3, vague), (4, ITEM), (5, "what is seven plus")]), items).collect()}
    assert {1, 4} <= set(got) and 5 in got and got[5]["item_id"] == 51
    assert got[1]["consistency"] == 1.0 and got[1]["n_slots"] > 3


def test_copies_match_whatever_stands_before_them_and_whatever_their_case(docs, items):
    bench = {1: "What is the capital of France?", 2: "In welchem Jahr fiel die Mauer?", 3: "Die Hauptstadt von Bayern heißt München und liegt an der Isar im Süden",
             4: "Anna has 5 apples and then Anna eats some"}
    given = items.sparkSession.createDataFrame(list(bench.items()), "item_id long, text string")
    rows, want = [], set()
    for i, text in bench.items():
        for k, copy in enumerate((text, "Trivia " + text, "Line\n" + text, "so: (" + text + ")", "7 " + text, text.upper(), "x " + text.title(), "x " + text.lower(), "Q. " + text.lower())):
            rows.append((10 * i + k, copy))
            want.add((10 * i + k, i))
    rows += [(60, "Tom has 8 apples and then Tom eats some"), (61, "see Tom has 8 apples and then Tom eats some")]
    want |= {(60, 4), (61, 4)}
    rows += [(70, "My city London is the capital of England"), (71, "This is the capital of Spain"), (72, "Bob has 8 apples and then Tom eats some")]
    assert pairs(contaminated(docs(rows), given)) == want


def test_alignments_of_many_slots(docs, items):
    bench = {1: "Compute 12 + 5 * 3 - 7 + 9 * 4", 2: "Sort 7, 3, 9, 1, 4, 8, 2, 6 in ascending order", 3: "Give 4 kg to Anna and 7 kg to Bob and 9 kg to Carl and 4 l to Anna",
             4: "1 , 2 , 3 , 4 , 5 , 6 , 7 , 8", 5: "3 5 7 9 11 13 15 17 19 21 23 25"}
    given = items.sparkSession.createDataFrame(list(bench.items()), "item_id long, text string")
    rows = [
        (1, "we ask: Compute 31 + 8 * 6 - 2 + 5 * 9 now"), (2, "Sort 5, 1, 6, 2, 9, 7, 3, 4 in ascending order"),
        (3, "then Give 5 g to Tom and 3 g to Eve and 8 g to Max and 5 m to Tom"), (4, "30 , 20 , 33 , 41 , 53 , 60 , 71 , 88"), (5, " ".join(map(str, range(100, 180, 3)))),
        (6, "Sort 5, 5, 6, 6, 9, 9, 3, 3 in ascending order"), (7, "Give 5 g to Tom and 5 g to Tom and 5 g to Tom and 1 m to Max"),
    ]
    assert pairs(contaminated(docs(rows), given)) == {(1, 1), (2, 2), (3, 3)}


def test_inconsistent_slots_are_no_leak(docs, items):
    """The numbers of one slot value go to different values."""
    item = "If 7 men need 7 days for 7 walls and each man takes 7 breaks then how long do they all work"
    other = "If 3 men need 5 days for 8 walls and each man takes 9 breaks then how long do they all work"
    renamed = item.replace("7", "4")
    bench = items.sparkSession.createDataFrame([(1, item)], "item_id long, text string")
    assert pairs(contaminated(docs([(1, other), (2, renamed), (3, item)]), bench)) == {(2, 1), (3, 1)}


def test_templates():
    kinds, hashes, _ = Templates().read(["Then Anna ran 5 km in 20min to Rome. In 5 h".split(), "then Bob ran 77 miles in 3min".split()])
    assert kinds.tolist() == [0, 2, 0, 1, 3, 0, 1, 0, 2, 0, 1, 3, 0, 2, 0, 1, 3, 0, 1]
    assert hashes[:7].tolist() == hashes[12:].tolist()


def test_empty(docs, items):
    assert contaminated(docs([]), items).count() == 0
    assert contaminated(docs([(1, ITEM)]), items.limit(0)).count() == 0


def test_words_of_few_texts_are_held_at_a_time():
    """A task's memory hangs on the text of a slice, not on that of a batch."""
    texts = [" ".join(f"word{(7 * i + k) % 5000}" for k in range(250)) for i in range(2000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(2000), pa.int64()), pa.array(texts), pa.array(range(2000), pa.int64())], names=["doc_id", "text", "text_hash"])
    find = decontamination._finder(np.zeros(1 << decontamination.MAP_BITS - 3, np.uint8), [8])
    tracemalloc.start()
    try:
        assert not list(find(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert sum(map(len, texts)) > 4_000_000 and peak < 35_000_000
