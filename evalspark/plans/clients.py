"""A deterministic stand-in for a model client, for tests and registered queries."""

from __future__ import annotations


class CountingClient:
    """Answers with the length of the prompt; some prompts fail."""

    def complete(self, request: str, max_tokens: int) -> dict:
        size = len(request)
        if size % 7 == 0:
            raise RuntimeError("no answer")
        return {"text": f"SELECT {size};", "prompt_tokens": size, "response_tokens": size % max_tokens}
