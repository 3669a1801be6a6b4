"""Pinned encoders, and the lock of a cache to one tokenizer implementation."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

from sparkgauge.operators.checks import ConstraintError
from sparkgauge.sources import store


@dataclass(frozen=True)
class Pinned:
    """Identity and expected shape of one frozen encoder."""

    repository: str
    revision: str
    vocabulary: int
    first: int = 0
    last: int = 2
    padding: int = 1
    width: int = 768
    blocks: int = 12

    @property
    def layers(self) -> int:
        """The embedding output and that of every block."""
        return self.blocks + 1


# Public encoders, their revisions, vocabulary sizes and special tokens.
ENCODERS = {
    "roberta-base": Pinned("roberta-base", "e2da8e2f811d1448a5b465c236feacd80ffbac7b", 50265),
    "deberta-v3-base": Pinned("microsoft/deberta-v3-base", "8ccc9b6f36199bec6961081d44eb72fb3f7353f3", 128000, first=1, padding=0),
    "xlm-roberta-base": Pinned("xlm-roberta-base", "e73636d4f797dec63c3081bb6ed5c7b0bb3f2089", 250002),
}
# Longest inputs of the main and of the sensitivity runs.
MAX_LENGTH, LONG_LENGTH = 256, 512


def pinned(key: str) -> Pinned:
    if key not in ENCODERS:
        raise ConstraintError(f"no pinned encoder {key}; there are {sorted(ENCODERS)}")
    return ENCODERS[key]


def lock_tokenizer(cache: str | Path, fast: bool) -> None:
    """Binds a cache folder to the fast or the slow tokenizers: the first call decides, another one's choice is an error."""
    Path(cache).mkdir(parents=True, exist_ok=True)
    try:
        store.publish_json(Path(cache) / "tokenizer_backend.json", {"tokenizer_is_fast": bool(fast)})
    except FileExistsError:
        raise ConstraintError(f"{cache} is bound to the other tokenizers; use another folder") from None
