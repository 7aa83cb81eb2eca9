"""A million equal characters in a row: no operator may fail on them, and the rows come back."""
import pytest

from helixframe.llm import op1_pii, op2_licences, op3_sentencepiece, op4_decontaminate, op6_suffixes, op9_tokens, op10_minhash

from .conftest import PROSE

RUNS = [(k, f"{PROSE[0]} {c * 1_000_000} {PROSE[1]}") for k, c in enumerate([" ", "\n", "x", "-", "7", "é"])]


@pytest.fixture(scope="module")
def runs(spark):
    return spark.createDataFrame(RUNS, "doc_id long, text string").repartition(3)


def test_token_counts_of_runs(runs):
    """Against the tokenizer on the parts it can take: a run's ids are those of its own piece."""
    import regex
    with open(op9_tokens.TOKENIZER, "rb") as f:
        raw = f.read()
    enc, ranks = op9_tokens.load_encoding(raw), op9_tokens.load_ranks(raw)
    want = {}
    for k, text in RUNS:
        pieces = [m.group() for m in regex.finditer(op9_tokens.PATTERN, text)]
        ids = [i for p in pieces for i in (op9_tokens.merged(p.encode(), ranks) if len(p) > 50 else enc.encode_ordinary(p))]
        assert enc.decode(ids) == text
        want[k] = len(ids)
    assert {r["doc_id"]: r["n_tokens"] for r in op9_tokens.token_counts(runs).collect()} == want


def test_merging_equals_the_tokenizer():
    import random

    import regex
    with open(op9_tokens.TOKENIZER, "rb") as f:
        raw = f.read()
    enc, ranks = op9_tokens.load_encoding(raw), op9_tokens.load_ranks(raw)
    r = random.Random(1)
    for _ in range(100):
        text = "".join(r.choice(r.choice([" ", "\n", " \n\t", "ab", "aé語", "-=", "the "])) for _ in range(r.choice([1, 2, 50, 400])))
        ids = []
        for m in regex.finditer(op9_tokens.PATTERN, text):
            ids += op9_tokens.merged(m.group().encode(), ranks)
        assert ids == enc.encode_ordinary(text)
    for text in ("a" + " " * 20_000 + "b \n" + "\n" * 7_000 + "c", "z" * 70_000 + " " + "-" * 66_000):
        assert op9_tokens.encoded(enc, ranks, text) == enc.encode_ordinary(text)


@pytest.mark.parametrize("name", ["op1", "op2", "op3", "op4", "op6", "op10"])
def test_others_take_runs(spark, runs, name):
    items = spark.createDataFrame([(1, PROSE[1])], "item_id long, text string")
    out = {"op1": lambda: op1_pii.scan(runs), "op2": lambda: op2_licences.licence_scan(runs), "op3": lambda: op3_sentencepiece.round_trip(runs),
           "op4": lambda: op4_decontaminate.contaminated(runs, items), "op6": lambda: op6_suffixes.remove_repeats(runs), "op10": lambda: op10_minhash.near_duplicates(runs)}[name]()
    assert {r["doc_id"] for r in out.select("doc_id").collect()} == {k for k, _ in RUNS}
