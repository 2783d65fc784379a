"""Survey preset: column names, fixed maps and bounds.

Every operator takes these as arguments; the survey is only one set of them.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

# Question texts of the raw survey table, in file order, with
# the canonical name used inside the library.
RAW_TO_CANONICAL = {
    "unique_id": "unique_id",
    "Painting": "painting",
    "On a scale of 1–10, how intense is the emotion conveyed by the artwork?": "intensity",
    "Describe how this painting makes you feel.": "feeling_text",
    "This art piece makes me feel sombre.": "likert_sombre",
    "This art piece makes me feel content.": "likert_content",
    "This art piece makes me feel calm.": "likert_calm",
    "This art piece makes me feel uneasy.": "likert_uneasy",
    "How many prominent colours do you notice in this painting?": "colours",
    "How many objects caught your eye in the painting?": "objects",
    "How much (in Canadian dollars) would you be willing to pay for this painting?": "payment",
    "If you could purchase this painting, which room would you put that painting in?": "room",
    "If you could view this art in person, who would you want to view it with?": "view_with",
    "What season does this art piece remind you of?": "season",
    "If this painting was a food, what would be?": "food_text",
    "Imagine a soundtrack for this painting. Describe that soundtrack without naming any objects in the painting.": "soundtrack_text",
}
CANONICAL_TO_RAW = {v: k for k, v in RAW_TO_CANONICAL.items()}

# Cells a CSV reader of the pandas family takes as missing.
NULL_TOKENS = [
    "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# Class titles and ids.
LABEL_TITLES = {0: "The Persistence of Memory", 1: "The Starry Night", 2: "The Water Lily Pond"}
LABEL_MAP = {title: i for i, title in LABEL_TITLES.items()}

# Answer texts of the agreement questions; three vintages differ in "3".
LIKERT_FINAL = {
    "1 - Strongly disagree": 1,
    "2 - Disagree": 2,
    "3 - Neutral/Unsure": 3,
    "3 - Neutral": 3,
    "4 - Agree": 4,
    "5 - Strongly agree": 5,
}
LIKERT_SCRIPT = {k: v for k, v in LIKERT_FINAL.items() if k != "3 - Neutral"}
LIKERT_ALTERNATIVE = {k: v for k, v in LIKERT_FINAL.items() if k != "3 - Neutral/Unsure"}

# Fixed value: upper bound of a payment.
PAYMENT_CAP = 324_000_000.0

MISSING = "Missing"


@dataclass(frozen=True)
class CleanSpec:
    """Which columns a cleaning plan treats how."""

    id_col: str = "unique_id"
    class_col: str = "painting"
    label_col: str = "label"
    label_map: dict = field(default_factory=lambda: dict(LABEL_MAP))
    ordinals: tuple = ("likert_sombre", "likert_content", "likert_calm", "likert_uneasy")
    ordinal_map: dict = field(default_factory=lambda: dict(LIKERT_FINAL))
    ordinal_bounds: tuple = (1, 5)
    money: str = "payment"
    money_cap: float = PAYMENT_CAP
    # count column -> fixed upper bound, or None for the ceiling of its 99th percentile
    counts: dict = field(default_factory=lambda: {"colours": 20, "objects": 50})
    upper_q: float = 0.99
    scales: dict = field(default_factory=lambda: {"intensity": (1, 10)})
    open_texts: tuple = ("food_text", "feeling_text", "soundtrack_text")
    multi_selects: tuple = ("room", "view_with", "season")
    # used where a whole column is missing
    defaults: dict = field(
        default_factory=lambda: {
            "payment": 100.0, "intensity": 5.0, "colours": 3.0, "objects": 3.0,
            "likert_sombre": 3.0, "likert_content": 3.0, "likert_calm": 3.0, "likert_uneasy": 3.0,
        }
    )
    max_missing: int = 4
    finite_counts: bool = True

    @property
    def texts(self) -> list[str]:
        return [self.class_col, *self.open_texts, *self.multi_selects]

    @property
    def discretes(self) -> list[str]:
        return [*self.scales, *self.counts, *self.ordinals]

    @property
    def numerics(self) -> list[str]:
        return [self.money, *self.discretes]

    @property
    def expected(self) -> list[str]:
        return [self.id_col, *self.texts, *self.numerics]

    def bounds(self, name: str) -> tuple:
        if name in self.scales:
            return self.scales[name]
        if name in self.counts:
            return (0, self.counts[name])
        return self.ordinal_bounds

    def with_(self, **changes) -> "CleanSpec":
        return replace(self, **changes)


SURVEY = CleanSpec()
SURVEY_SCRIPT = SURVEY.with_(
    ordinal_map=dict(LIKERT_SCRIPT), counts={"colours": None, "objects": None},
    defaults={}, finite_counts=False,
)
SURVEY_ALTERNATIVE = SURVEY.with_(
    ordinal_map=dict(LIKERT_ALTERNATIVE), counts={"colours": None, "objects": None},
    defaults={}, finite_counts=False,
)


@dataclass(frozen=True)
class TrainSpec:
    """Vocabulary sizes and smoothing of the text models, and the class penalty."""

    vocab_sizes: dict = field(
        default_factory=lambda: {"food_text": 38, "feeling_text": 44, "soundtrack_text": 62}
    )
    nb_alpha: float = 0.5
    C: float = 0.5


# Tuned parameters of the final model and of the three alternatives.
FINAL = TrainSpec()
ALTERNATIVE = TrainSpec(
    vocab_sizes={"food_text": 42, "feeling_text": 38, "soundtrack_text": 62}, nb_alpha=1.0
)
KNN_PARAMS = {"k": 27, "p": 1, "weights": "distance", "subset_size": 20, "seed": 42}
FOREST_PARAMS = {
    "trees": 146, "depth": 9, "min_leaf": 2, "features": "log2", "bootstrap": True, "seed": 42,
}
MLP_PARAMS = {"hidden": (64, 32), "max_iter": 500, "seed": 42}
# the perceptron with a penalty and early stopping
PENALIZED_MLP_PARAMS = {
    "hidden": (64, 32), "penalty": 5e-3, "rate": 2e-3, "batch": 16, "max_iter": 500, "patience": 20, "seed": 42,
}
