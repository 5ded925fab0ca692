"""Join-function space: (preprocess, tokenize, weight, distance) tuples."""

from __future__ import annotations

import itertools
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column

SET_DISTANCES = ("containJaccardDistance", "containCosineDistance", "containDiceDistance",
                 "intersectDistance", "jaccardDistance", "cosineDistance", "diceDistance",
                 "maxincDistance")
CHAR_DISTANCES = ("editDistance", "jaroDistance")

# The three built-in spaces (option lists per slot).
BUILTIN_SPACES = {
    "lg": {
        "preprocess_methods": ["lower", "lowerStem", "lowerRemovePunctuation",
                               "lowerRemovePunctuationStem"],
        "tokenize_methods": ["threeGram", "splitBySpace"],
        "token_weights": ["uniformWeight", "idfWeight"],
        "char_distance_functions": ["editDistance", "jaroDistance"],
        "set_distance_functions": ["containJaccardDistance", "containCosineDistance",
                                   "containDiceDistance", "intersectDistance", "jaccardDistance",
                                   "cosineDistance", "diceDistance", "maxincDistance"],
    },
    "md": {
        "preprocess_methods": ["lower", "lowerStem", "lowerRemovePunctuationStem"],
        "tokenize_methods": ["threeGram", "splitBySpace"],
        "token_weights": ["uniformWeight", "idfWeight"],
        "char_distance_functions": ["editDistance", "jaroDistance"],
        "set_distance_functions": ["containJaccardDistance", "containCosineDistance",
                                   "containDiceDistance", "intersectDistance", "jaccardDistance",
                                   "cosineDistance", "diceDistance", "maxincDistance"],
    },
    "sm": {
        "preprocess_methods": ["lower", "lowerRemovePunctuationStem"],
        "tokenize_methods": ["threeGram", "splitBySpace"],
        "token_weights": ["idfWeight"],
        "char_distance_functions": ["jaroDistance"],
        "set_distance_functions": ["containCosineDistance", "jaccardDistance", "maxincDistance"],
    },
}


@dataclass(frozen=True)
class JoinFunction:
    """A built-in join function; char-based ones have no tokenizer/weight."""

    preprocess: str
    tokenize: str | None
    weight: str | None
    distance: str

    @property
    def name(self) -> str:
        return f"{self.preprocess}_{self.tokenize}_{self.weight}_{self.distance}"

    @property
    def group(self) -> tuple:
        """Functions sharing a group share one token profile per record."""
        return (self.preprocess, self.tokenize, self.weight)

    @property
    def is_set(self) -> bool:
        return self.tokenize is not None


class CustomJoinFunction(Protocol):
    """User join function: a unique ``name`` and a distance expression over
    the raw left / right values of one column (Catalyst expression or a
    pandas UDF).  Applied identically to LL and LR pairs."""

    name: str

    def distance(self, left: Column, right: Column) -> Column: ...


def expand(options: dict) -> list[JoinFunction]:
    """Cartesian product: set-based functions first, then char-based."""
    out = []
    for pre, tok, w, d in itertools.product(options.get("preprocess_methods", []),
                                            options.get("tokenize_methods", []),
                                            options.get("token_weights", []),
                                            options.get("set_distance_functions", [])):
        out.append(JoinFunction(pre, tok, w, d))
    for pre, d in itertools.product(options.get("preprocess_methods", []),
                                    options.get("char_distance_functions", [])):
        out.append(JoinFunction(pre, None, None, d))
    return out


def resolve(space) -> list:
    """A space given by built-in name, option dict or list of functions."""
    if isinstance(space, str):
        if space not in BUILTIN_SPACES:
            raise ValueError(f"unknown join function space {space}")
        return expand(BUILTIN_SPACES[space])
    if isinstance(space, dict):
        return expand(space)
    return list(space)


def from_name(name: str) -> JoinFunction:
    pre, tok, w, d = name.split("_")
    return JoinFunction(pre, None if tok == "None" else tok, None if w == "None" else w, d)
