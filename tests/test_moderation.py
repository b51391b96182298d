import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.functions import moderation

CASES = {
    "you i d i o t": (True, "idiot"),
    "you 1d10t!": (True, "idiot"),
    "ІDІОТ": (True, "idiot"),
    "ｉｄïôt": (True, "idiot"),
    "idioooot, IDIOTS": (True, "idioooot idiots"),
    "what an @$$": (True, "ass"),
    "m.o.r.o.n": (True, "moron"),
    "sh!t": (True, "shit"),
    "creepercreep": (True, "creepercreep"),
    "as was said, 4 5 5 and 455": (False, ""),
    "classic bass, passing assassin": (False, ""),
    "parsed, coarser and rehearsed": (False, ""),
    "a b c": (False, ""),
    "": (False, ""),
    None: (False, ""),
}


@pytest.fixture(scope="module")
def judged(spark):
    rows = spark.createDataFrame([(t,) for t in CASES], "text string").withColumn("hits", moderation.flagged_words(moderation.normalised(F.col("text"))))
    return {r.text: (bool(r.hits), " ".join(r.hits)) for r in rows.collect()}


def test_disguises_and_innocent_words(judged):
    assert judged == CASES


def test_automaton_equals_the_expressions():
    rnd = random.Random(3)
    search = moderation.Terms(moderation.TERMS, moderation.INNOCENT)
    words = [rnd.choice(["", "s", "x", "pa"]) + rnd.choice(moderation.TERMS + moderation.INNOCENT) + rnd.choice(["", "s", "ed", "e", rnd.choice(moderation.TERMS)]) for _ in range(6000)]
    words += ["".join(c * rnd.choice([1, 1, 1, 2, 3]) for c in w) for w in words] + ["".join(rnd.choice("as") for _ in range(rnd.randrange(1, 6))) for _ in range(300)]
    for w in words:
        assert search.holds(w) == bool(re.search(moderation.pattern(), re.sub(moderation.innocent_pattern(), ".", w))), w


def test_own_lists(spark):
    rows = spark.createDataFrame([("tax and taxi",)], "text string")
    assert rows.select(moderation.flagged_words(F.col("text"), ["taxi"], []).alias("w")).first().w == ["taxi"]
    assert rows.select(moderation.flagged_words(F.col("text"), [], []).alias("w")).first().w == []
    with pytest.raises(ValueError):
        moderation.Terms([str(k) for k in range(moderation.MAX_TERMS + 1)], [])
