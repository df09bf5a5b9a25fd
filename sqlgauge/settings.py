"""Parameters of the operators, with the defaults every stage shares."""

from __future__ import annotations

from dataclasses import dataclass, field

# Fixed value: the system instruction every prompt starts with.
SYSTEM_PROMPT = (
    "You are an expert SQL assistant. Given a database schema and a "
    "natural language question, generate the correct SQL query. "
    "Output ONLY the SQL query, nothing else."
)


@dataclass(frozen=True)
class PromptSettings:
    system_prompt: str = SYSTEM_PROMPT
    with_types: bool = True
    with_foreign_keys: bool = True
    max_seq_length: int | None = 1024
    chars_per_token: int = 4

    @property
    def max_chars(self) -> int | None:
        """Characters that a text may have; None for no limit."""
        return None if self.max_seq_length is None else self.max_seq_length * self.chars_per_token


@dataclass(frozen=True)
class AugmentationSettings:
    top_k: int = 3
    threshold: float = 15.0
    multiplier: int = 3
    seed: int = 42
    gold_as_query: bool = False


@dataclass(frozen=True)
class BootstrapSettings:
    reps: int = 10_000
    confidence: float = 0.95
    seed: int = 42


@dataclass(frozen=True)
class Settings:
    prompts: PromptSettings = field(default_factory=PromptSettings)
    augmentation: AugmentationSettings = field(default_factory=AugmentationSettings)
    bootstrap: BootstrapSettings = field(default_factory=BootstrapSettings)
    validation_ratio: float = 0.1
    split_seed: int = 42
    train_subset: int | None = None
    eval_subset: int | None = None
    running_every: int = 50
    statement_timeout: float = 30.0
