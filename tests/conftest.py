from __future__ import annotations

import os
import random
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.dirname(os.path.abspath(__file__))]

from surveyloom.schema import CANONICAL_TO_RAW, RAW_TO_CANONICAL  # noqa: E402
from surveyloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(app="tests")


LIKERTS = ("likert_sombre", "likert_content", "likert_calm", "likert_uneasy")


def hostile_rows() -> list[dict]:
    """Seven hazards, by canonical name: nothing, wrong kinds of values, numbers beyond all
    bounds, noise, a lone field, words for no number, and an ordinary record."""
    wrong = dict(zip(LIKERTS, ("often", "57 apples", "yes/no", "~")))
    wrong |= {"unique_id": "id?", "painting": "Untitled No. 9", "intensity": "rather weak", "payment": "ask my sister"}
    wrong |= {"colours": "several", "objects": "[]", "feeling_text": 31, "food_text": 2.5, "soundtrack_text": False}
    wrong |= {"room": "Garage;Cellar", "view_with": "Pets", "season": "Harvest"}
    beyond = dict(zip(LIKERTS, (62, -8, 10**9, 5.75e11)))
    beyond |= {"unique_id": 7**40, "painting": "The Water Lily Pond", "intensity": 4 * 10**15, "colours": 3**60}
    beyond |= {"objects": -(5**20), "payment": "8" * 28 + " dollars", "feeling_text": "... ...", "season": "Winter,Winter"}
    beyond |= {"food_text": "soup " * 40, "soundtrack_text": "drum drum", "room": "Office,Attic", "view_with": "Friends,Friends"}
    symbols = "@@ ;; <> \\ \u2603 \U0001f3bb \u96ea " * 90
    noise = dict.fromkeys(LIKERTS, "4 - Agree") | {"painting": "#!%", "feeling_text": symbols, "food_text": symbols + "tea"}
    noise |= {"soundtrack_text": "\t;;\t", "payment": "0, whatever the rest of it about 9k says", "room": " , ,", "season": ""}
    no_number = dict(zip(LIKERTS, ("nan", "Infinity", "-Infinity", "NaN")))
    no_number |= {"unique_id": "NaN", "intensity": "nan", "colours": "Infinity", "objects": "-inf", "payment": "nothing, honestly"}
    plain = dict(zip(LIKERTS, ("1 - Strongly disagree", "3 - Neutral", "4 - Agree", "2 - Disagree")))
    plain |= {"unique_id": 41, "painting": "The Starry Night", "intensity": 4, "colours": 6, "objects": 9, "payment": "75"}
    plain |= {"feeling_text": "awake and small under a wide sky", "food_text": "cake with berries", "soundtrack_text": "a cello"}
    plain |= {"room": "Office", "view_with": "By yourself", "season": "Fall"}
    return [{}, wrong, beyond, noise, {"soundtrack_text": "rain on a tin roof"}, no_number, plain]


@pytest.fixture(scope="session")
def hostile():
    """The same records under the raw question texts."""
    return [{CANONICAL_TO_RAW[k]: v for k, v in r.items()} for r in hostile_rows()]


def survey_rows(n: int = 150, seed: int = 7) -> list[dict]:
    """Answers whose wording depends on the painting, with gaps."""
    rng = random.Random(seed)
    kinds = {
        "The Persistence of Memory": (["clock", "time", "strange", "desert"], ["noodles", "pizza", "cheese"], ["slow", "ticking", "eerie"], ["Office"]),
        "The Starry Night": (["night", "sky", "swirl", "dreamy"], ["blueberries", "cake", "cream"], ["violin", "wind", "night"], ["Bedroom", "Living room"]),
        "The Water Lily Pond": (["calm", "green", "peaceful", "water"], ["salad", "fruit", "tea"], ["birds", "piano", "soft"], ["Bathroom", "Dining room"]),
    }
    rows = []
    for i in range(n):
        title = list(kinds)[i % 3]
        feel, food, sound, room = kinds[title]

        def say(words, filler):
            return " ".join(rng.sample(words, 2) + [rng.choice(filler)])

        row = {
            "unique_id": str(i // 3),
            "painting": title,
            "intensity": str(rng.randint(1, 11)),
            "feeling_text": "It makes me feel " + say(feel, ["sad", "happy", "warm"]),
            "likert_sombre": rng.choice(["1 - Strongly disagree", "2 - Disagree", "3 - Neutral/Unsure"]),
            "likert_content": rng.choice(["3 - Neutral", "4 - Agree", "5 - Strongly agree"]),
            "likert_calm": rng.choice(["4 - Agree", "5 - Strongly agree"]),
            "likert_uneasy": rng.choice(["1 - Strongly disagree", "2 - Disagree"]),
            "colours": str(rng.randint(-1, 25)),
            "objects": str(rng.randint(0, 60)),
            "payment": rng.choice(["50 dollars", "$1.5k", "idk", "free", "max 300, maybe 250", "2 million"]),
            "room": ",".join(room),
            "view_with": rng.choice(["Friends", "Family members,Friends", "By yourself"]),
            "season": rng.choice(["Fall", "Spring,Summer", "Winter"]),
            "food_text": say(food, ["sweet", "cold"]),
            "soundtrack_text": say(sound, ["music", "melody"]),
        }
        for gap in rng.sample(list(row)[2:], rng.randint(0, 2)):
            row[gap] = None
        rows.append(row)
    return rows


@pytest.fixture(scope="session")
def raw_survey(spark):
    cols = list(RAW_TO_CANONICAL.values())
    data = [tuple(r[c] for c in cols) for r in survey_rows()]
    return spark.createDataFrame(data, ", ".join(f"{c} string" for c in cols))
