"""Options of a run."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    """``n_ctx`` tokens per window, ``batch`` tokens per scoring call, ``argmax`` instead of the constrained search,
    ``skip_beta`` for expert skipping (0: off), ``span_cap`` spans per category and document (None: all),
    ``specials`` whether special-token literals in a text become special tokens, ``vocabulary`` a rank
    file (None: that of the model, or pretokens stand in for tokens), ``model`` the folder or weights file of a trained
    model (None: rules score), ``linger_ms`` the micro-batch interval of streams, ``rules`` pairs of category and pattern
    that are applied one after another in place of the engine's own rules."""

    n_ctx: int = 4096
    batch: int = 16384
    argmax: bool = False
    skip_beta: float = 0.0
    span_cap: int | None = None
    specials: bool = True
    vocabulary: str | None = None
    model: str | None = None
    linger_ms: int = 8
    rules: tuple[tuple[str, str], ...] | None = None

    def __post_init__(self) -> None:
        if self.n_ctx < 1 or self.batch < 1:
            raise ValueError("n_ctx and batch must be positive")
        if self.skip_beta < 0 or self.linger_ms < 0:
            raise ValueError("skip_beta and linger_ms must not be negative")
        if self.span_cap is not None and self.span_cap < 0:
            raise ValueError("span_cap must not be negative")

    @property
    def budget(self) -> int:
        return max(self.batch, self.n_ctx)
