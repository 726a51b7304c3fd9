"""Texts of a megabyte and values of any number: time grows with the text, and no task runs out of stack."""

import random
import time

import pytest

from townloom.llm import pii
from tests.llm.test_llm import luhn


def card(r):
    digits = "4" + "".join(str(r.randint(0, 9)) for _ in range(14))
    return next(digits + c for c in "0123456789" if luhn(digits + c))


@pytest.mark.parametrize("name", ["dots", "dashes", "labels", "ats", "digits", "cards"])
def test_pseudonyms_of_long_rows(spark, name):
    r = random.Random(1)
    texts = {"dots": "1 " + "a." * 500_000, "dashes": "1 " + "a-" * 500_000, "labels": "a@" + "b." * 100_000 + "com 1",
             "ats": "a@b." * 250_000, "digits": "12345678 " * 110_000, "cards": " x ".join(card(r) for _ in range(10_000))}
    start = time.time()
    row = pii.pseudonymize(spark.createDataFrame([(1, texts[name])], "doc_id bigint, text string"), "k", count_col="n").first()
    assert time.time() - start < 60 and len(row.text) == len(texts[name])
    assert row.n == (10_000 if name == "cards" else 0) and (row.text == texts[name]) == (name != "cards")


def test_address_at_the_end_of_a_dotted_run(spark):
    text = "a." * 5000 + " jo.doe@x.example.com " + "b@" * 3000 + "last@end.org"
    row = pii.pseudonymize(spark.createDataFrame([(text,)], "text string"), "k", count_col="n").first()
    assert row.n == 2 and "@x.example.com " in row.text and row.text.endswith("@end.org") and "jo.doe" not in row.text
