"""The claim grammar on sentences whose reading is plain."""

import pytest

from arcweave.operators import claims
from arcweave.plans.dialect import SPARK

CASES = [
    ("Light is the opposite of darkness.", "opposition", "opposition", "Light", "darkness"),
    ("Cats are a kind of animal", "taxonomic", "affinity", "Cats", "animal"),
    ("The dawn occurred before the noon", "temporal", "order_before", "The dawn", "the noon"),
    ("Noon is later than dawn", "temporal", "order_after", "Noon", "dawn"),
    ("Winter precedes spring", "temporal", "order_before", "Winter", "spring"),
    ("Spring followed winter", "temporal", "order_after", "Spring", "winter"),
    ("The war lies in the past", "temporal", "locative", "The war", "past"),
    ("The meeting happened yesterday.", "temporal", "locative", "The meeting", "yesterday"),
    ("The feast is tomorrow", "temporal", "locative", "The feast", "tomorrow"),
    ("The feast is tomorrow evening", "identity", "synonym", "The feast", "tomorrow evening"),
    ("Fire leads to smoke", "causal", "affinity", "Fire", "smoke"),
    ("A whale is a mammal", "identity", "synonym", "A whale", "mammal"),
    ("Doves symbolize peace", "freeform", "", "Doves", "peace"),
    ("green ideas sleep furiously", "freeform", "", "green ideas", "sleep furiously"),
    ("three plain words", "freeform", "", "three", "plain words"),
    ("Silence", "freeform", "", "Silence", "Silence"),
]


def test_readings(spark):
    spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "claim_id long, text string").createOrReplaceTempView("claims")
    rows = spark.sql(f"WITH {claims.parsed(SPARK)} SELECT * FROM parsed").collect()
    got = {r.claim_id: (r.claim_type, r.hint, r.subject, r.predicate) for r in rows}
    assert got == {i: c[1:] for i, c in enumerate(CASES)}
