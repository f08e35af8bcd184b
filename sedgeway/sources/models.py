"""What a model behind a seam needs: its settings, and the text of its replies.  No client is made here."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields
from typing import Any

import pandas as pd

#: The roles a model can have.
ROLES = ("embed", "rerank", "contextualize", "rewrite", "generate", "transcribe")


class MissingKey(RuntimeError):
    """A call without a key; settings may lack one, so that a process without models starts."""


@dataclass(frozen=True)
class Model:
    """One role's model: its id, the key of its provider (may be empty), and the limits of a call."""

    role: str
    name: str
    key: str = ""
    timeout_seconds: float = 60.0
    max_tokens: int | None = None

    def __post_init__(self) -> None:
        problems = {
            "role": self.role not in ROLES, "name": not self.name.strip(), "timeout_seconds": self.timeout_seconds <= 0,
            "max_tokens": self.max_tokens is not None and self.max_tokens <= 0,
        }
        wrong = [f.name for f in fields(self) if problems.get(f.name)]
        if wrong:
            raise ValueError(f"not usable: {', '.join(wrong)}")

    def calling(self, call: Callable[[Model, Any], Any]) -> Callable[[pd.Series], pd.Series]:
        """``call(model, prompt)`` as the batch function that seams take; without a key the first call fails, not the start."""

        def run(prompts: pd.Series) -> pd.Series:
            if not self.key:
                raise MissingKey(f"{self.name} has no key")
            return prompts.map(lambda p: reply_text(call(self, p)))

        return run


def reply_text(reply: Any) -> str:
    """Text of a chat reply: a string, or blocks of which those of text are joined; an object's ``content`` is taken."""
    content = getattr(reply, "content", reply)
    if isinstance(content, str) or content is None:
        return content or ""
    texts = (b if isinstance(b, str) else b.get("text") if isinstance(b, dict) and b.get("type") == "text" else None for b in content)
    return "".join(t for t in texts if isinstance(t, str))


def location(path: str) -> str:
    """A warehouse path as a URI: a bare one is a local file's; a scheme, where there is one, stays."""
    scheme, separator, rest = path.partition("://")
    if not path.strip() or separator and not (scheme and rest):
        raise ValueError(f"no usable location: {path!r}")
    if separator or path.startswith(("file:", "hdfs:")):
        return path.rstrip("/")
    import os

    return "file://" + os.path.abspath(path)
