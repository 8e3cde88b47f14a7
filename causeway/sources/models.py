"""Language model backends: responders that run a command or call an HTTP server, by name; all are optional."""

from __future__ import annotations

import json
import subprocess
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass, field

from causeway.operators.routing import EchoResponder, Responder

JSON_ONLY = "\n\nAnswer with one JSON object and nothing else."


def with_system(prompt: str, system: str | None) -> str:
    return f"<system>\n{system}\n</system>\n{prompt}\n" if system else prompt


@dataclass
class CommandResponder:
    """Runs a program once a prompt, the prompt on its standard input; time-outs and failures raise. Retries with growing
    pauses are ``routing.respond``'s."""

    command: list[str] = field(default_factory=lambda: ["ollama", "run", "qwen2:7b"])
    timeout: float = 120.0
    json_mode: bool = True
    system: str | None = None

    def __call__(self, prompts: list[str]) -> list[str]:
        return [self.one(p) for p in prompts]

    def one(self, prompt: str) -> str:
        text = with_system(prompt, self.system) + (JSON_ONLY if self.json_mode else "")
        done = subprocess.run(self.command, input=text, capture_output=True, text=True, timeout=self.timeout, check=False)
        if done.returncode:
            raise RuntimeError(f"{self.command[0]} failed: {done.stderr.strip()[:500]}")
        return done.stdout.strip()

    def ping(self) -> bool:
        try:
            return subprocess.run([self.command[0], "--version"], capture_output=True, timeout=2, check=False).returncode == 0
        except (OSError, subprocess.TimeoutExpired):
            return False


def fetch_json(url: str, body: dict | None = None, headers: dict | None = None, timeout: float = 10.0) -> dict:
    """A GET, or a POST of ``body``, that answers in JSON."""
    data = None if body is None else json.dumps(body).encode()
    request = urllib.request.Request(url, data, {"Content-Type": "application/json", **(headers or {})})
    with urllib.request.urlopen(request, timeout=timeout) as reply:  # noqa: S310 - the caller names the server
        return json.load(reply)


@dataclass
class HttpResponder:
    """Calls a chat completion endpoint of the widely used shape once a prompt."""

    url: str = "http://localhost:11434/v1"
    model: str = "qwen2:7b"
    key: str | None = None
    temperature: float = 0.0
    max_tokens: int = 2048
    timeout: float = 120.0
    system: str | None = None
    fetch: Callable[..., dict] = fetch_json

    def __call__(self, prompts: list[str]) -> list[str]:
        headers = {"Authorization": f"Bearer {self.key}"} if self.key else {}
        out = []
        for prompt in prompts:
            messages = [*([{"role": "system", "content": self.system}] if self.system else []), {"role": "user", "content": prompt + JSON_ONLY}]
            body = {"model": self.model, "messages": messages, "temperature": self.temperature, "max_tokens": self.max_tokens}
            out.append(self.fetch(f"{self.url}/chat/completions", body, headers, self.timeout)["choices"][0]["message"]["content"])
        return out

    def ping(self) -> bool:
        """Whether the server answers within two seconds."""
        try:
            self.fetch(f"{self.url}/models", None, {}, 2.0)
            return True
        except Exception:  # noqa: BLE001 - any failure means no
            return False


BACKENDS: dict[str, Callable[..., Responder]] = {"echo": EchoResponder, "command": CommandResponder, "http": HttpResponder}


def responder(backend: str = "echo", **options) -> Responder:
    """A backend by name."""
    if backend not in BACKENDS:
        raise ValueError(f"the backend must be one of {sorted(BACKENDS)}")
    return BACKENDS[backend](**options)
