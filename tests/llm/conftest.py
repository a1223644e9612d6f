from __future__ import annotations

import random

import pytest

SYLLABLES = "the an er on re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve".split()


def prose(r: random.Random, words: int) -> str:
    return " ".join("".join(r.choices(SYLLABLES, k=r.randint(1, 4))) for _ in range(words))


@pytest.fixture
def docs_of(spark):
    """Documents with all their columns, some with extra ones whose names the operators use themselves."""
    def make(texts, extra: bool = True):
        rows = [(k, t, "en", "src0", len(t) if t is not None else None, "x", 7) if extra else (k, t)
                for k, t in (texts.items() if isinstance(texts, dict) else texts)]
        kinds = "doc_id long, text string" + (
            ", lang string, source string, n_chars long, component string, count int" if extra else "")
        return spark.createDataFrame(rows, kinds)
    return make
