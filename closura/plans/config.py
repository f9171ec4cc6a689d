"""Settings from the environment, checked before anything runs."""

from __future__ import annotations

import os
from dataclasses import dataclass

from closura.functions.tokens import VOCABULARY


@dataclass(frozen=True)
class Config:
    """CLOSURA_ROOT: folder of the tables; CLOSURA_BUDGET: default budget; CLOSURA_VOCABULARY: tokenizer file."""

    root: str
    budget: int = 8000
    vocabulary: str = VOCABULARY

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None) -> Config:
        env = dict(os.environ) if env is None else env
        wrong = []
        root = env.get("CLOSURA_ROOT", "")
        if not root:
            wrong.append("CLOSURA_ROOT is not set")
        budget = env.get("CLOSURA_BUDGET", "8000")
        if not budget.isdigit() or int(budget) <= 0:
            wrong.append("CLOSURA_BUDGET must be a positive number")
        vocabulary = env.get("CLOSURA_VOCABULARY", VOCABULARY)
        if not os.path.isfile(vocabulary):
            wrong.append(f"no tokenizer at {vocabulary}")
        if wrong:
            raise ValueError("; ".join(wrong))
        return cls(root, int(budget), vocabulary)
