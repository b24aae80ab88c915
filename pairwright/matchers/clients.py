"""What a matcher asks of a model, a client for chat services, and an offline one."""

from __future__ import annotations

import json
import os
import re
from dataclasses import dataclass
from typing import Protocol

# Fixed value: the model asked for when the environment names none.
DEFAULT_MODEL = "gpt-oss-120b"


@dataclass
class Reply:
    content: str | None
    tokens: int = 0


class ChatClient(Protocol):
    """Answers a list of role/content messages."""

    def complete(self, messages: list[dict]) -> Reply: ...


class ServiceClient:
    """Chat completions over the ``openai`` package, configured from the environment.

    Built inside each task, so no connection or key travels with the plan.
    """

    def __init__(self, base_url: str | None = None) -> None:
        key = os.environ.get("OPENAI_API_KEY")
        if not key:
            raise ValueError("OPENAI_API_KEY is not set")
        try:
            from openai import OpenAI
        except ImportError as error:
            raise RuntimeError("the openai package is needed to call a chat service") from error
        self._client = OpenAI(api_key=key, base_url=base_url)
        self._model = os.environ.get("MODEL_NAME", DEFAULT_MODEL)

    def complete(self, messages: list[dict]) -> Reply:
        answer = self._client.chat.completions.create(
            model=self._model,
            messages=messages,
            temperature=0,
            response_format={"type": "json_object"},
        )
        message = answer.choices[0].message
        return Reply(message.content, answer.usage.total_tokens if answer.usage else 0)


class WordOverlapClient:
    """Answers without any network, from the words the two names share.

    It stands in for a service in tests and lets the pipelines run where there is none.
    """

    _NAME = re.compile(r"^  Name: (.*)$", re.MULTILINE)

    def complete(self, messages: list[dict]) -> Reply:
        question = next(m["content"] for m in messages if m["role"] == "user")
        names = self._NAME.findall(question)[:2]
        first, second = (set(n.lower().split()) for n in names)
        score = len(first & second) / len(first | second) if first | second else 0.0
        answer = {
            "verdict": "MATCH" if score >= 0.5 else "NO MATCH",
            "confidence": max(score, 1.0 - score),
            "reasoning": f"{len(first & second)} shared words",
        }
        return Reply(json.dumps(answer), len(question.split()))
