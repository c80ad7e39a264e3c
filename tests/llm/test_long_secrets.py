"""Secrets of any length are replaced whole, after labels in any case."""

from __future__ import annotations

import random
import string

import pytest

from stationlens.llm import pii

RNG = random.Random(4)
ALNUM = string.ascii_letters + string.digits


def drawn(letters: str, n: int) -> str:
    return "".join(RNG.choices(letters, k=n))


JWT = ".".join([f"eyJ{drawn(ALNUM, 33)}", f"eyJ{drawn(ALNUM + '_-', 150)}", drawn(ALNUM + "_-", 42) + "x"])
SECRETS = [("hash ", drawn("0123456789abcdef", 128)), ("Password: ", drawn(ALNUM, 12)), ("token=", drawn(ALNUM, 100)), ('api_key = "', drawn(ALNUM + "/+", 85) + "x=="), ("Token: ", JWT), ("secret: ", f"{drawn(ALNUM, 40)}/{drawn(ALNUM, 60)}"), ("Secret=", f"+{drawn(ALNUM, 20)}"), ("password: ", f"{drawn(ALNUM, 10)}üß{drawn(ALNUM, 5)}")]


@pytest.fixture(scope="module")
def replaced(spark):
    rows = [(i, f"see {label}{secret}. Then on") for i, (label, secret) in enumerate(SECRETS)]
    return {r.doc_id: r for r in pii.replace_entities(spark.createDataFrame(rows, "doc_id long, text string"), "key").collect()}


@pytest.mark.parametrize("i", range(len(SECRETS)))
def test_whole_secret_is_replaced(replaced, i):
    label, secret = SECRETS[i]
    r = replaced[i]
    assert r.n_entities == 1 and r.text.startswith(f"see {label}") and r.text.endswith(". Then on")
    made = r.text[len(f"see {label}") : -len(". Then on")]
    assert len(made) == len(secret)
    assert not any(secret[k : k + 8] in made for k in range(len(secret) - 7))
