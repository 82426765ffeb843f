"""Clients of model servers over HTTP, with the protocols of ``models``; built in the Python worker that calls them."""

from __future__ import annotations

import json
import os
import urllib.request
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

#: Fixed value: the reply to fall back on where a graph is asked for and none can be had.
EMPTY_GRAPH = '{"entities": [], "relations": []}'


def post(url: str, body: dict, key: str | None, seconds: float) -> dict:
    head = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {})
    with urllib.request.urlopen(urllib.request.Request(url, json.dumps(body).encode(), head), timeout=seconds) as reply:
        return json.loads(reply.read())


@dataclass
class ChatClient:
    """A chat server: ``url`` gets {model, messages, ...} and gives {choices: [{message: {content}}]}.

    ``single_turn`` asks without a history; ``multi_turn`` asks with all turns since ``reset``. The
    name of the environment variable with the key is a parameter, its value stays in the worker.
    Errors are raised, so that callers retry; with ``fallback`` its text is the reply instead.
    """

    url: str
    model: str = "default"
    key_variable: str | None = None
    temperature: float = 0.0
    most_tokens: int = 2048
    as_json: bool = False
    seconds: float = 120.0
    threads: int = 8
    system: str | None = None
    fallback: str | None = None
    history: list[dict[str, str]] = field(default_factory=list)

    def _ask(self, messages: list[dict[str, str]]) -> str:
        body = {"model": self.model, "messages": messages, "temperature": self.temperature, "max_tokens": self.most_tokens}
        if self.as_json:
            body["response_format"] = {"type": "json_object"}
        try:
            return post(self.url, body, os.environ.get(self.key_variable) if self.key_variable else None, self.seconds)["choices"][0]["message"]["content"]
        except Exception:
            if self.fallback is None:
                raise
            return self.fallback

    def _first(self) -> list[dict[str, str]]:
        return [{"role": "system", "content": self.system}] if self.system else []

    def single_turn(self, prompt: str) -> str:
        return self._ask([*self._first(), {"role": "user", "content": prompt}])

    def multi_turn(self, prompt: str) -> str:
        asked = {"role": "user", "content": prompt}
        reply = self._ask([*self._first(), *self.history, asked])
        self.history += [asked, {"role": "assistant", "content": reply}]
        return reply

    def reset(self) -> None:
        self.history.clear()

    def complete(self, prompts: list[str]) -> list[str]:
        """Replies to prompts of no shared history, several at a time."""
        with ThreadPoolExecutor(min(self.threads, max(len(prompts), 1))) as pool:
            return list(pool.map(self.single_turn, prompts))


@dataclass
class CompletionClient:
    """A completion server: ``url`` gets {model, prompt, ...} and gives {choices: [{text}]}; a failure is an empty text."""

    url: str
    model: str = "default"
    key_variable: str | None = None
    temperature: float = 0.0
    most_tokens: int = 256
    seconds: float = 120.0

    def complete(self, prompts: list[str]) -> list[str]:
        out = []
        for prompt in prompts:
            body = {"model": self.model, "prompt": prompt, "temperature": self.temperature, "max_tokens": self.most_tokens}
            try:
                out.append(post(self.url, body, os.environ.get(self.key_variable) if self.key_variable else None, self.seconds)["choices"][0]["text"])
            except Exception:
                out.append("")
        return out


class Checked:
    """A model whose replies must pass a check: another one is an error, so that the caller tries again."""

    def __init__(self, model, check: Callable[[str], bool]):
        self.model, self.check = model, check

    def complete(self, prompts: list[str]) -> list[str]:
        replies = self.model.complete(prompts)
        if not all(map(self.check, replies)):
            raise ValueError("a reply can't be used")
        return replies


class Scripted:
    """A model for tests: the reply that a rule gives for each prompt."""

    def __init__(self, rule: Callable[[str], str]):
        self.rule = rule

    def complete(self, prompts: list[str]) -> list[str]:
        return [self.rule(p) for p in prompts]
