"""Language-model clients behind one protocol: signed HTTP, three public APIs, and an echo for tests."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
import os
import time
import uuid
from dataclasses import dataclass, field
from typing import Protocol, runtime_checkable


class ClientError(Exception):
    """Any failure of a client."""


class ProviderError(Exception):
    """Unknown or badly configured provider."""


@dataclass
class Message:
    role: str
    content: str


@dataclass
class Response:
    content: str
    model: str | None = None
    usage: dict | None = None
    raw_response: dict | None = field(default=None, repr=False)


@runtime_checkable
class Client(Protocol):
    def chat(self, messages: list, max_tokens: int | None = None, temperature: float | None = None) -> Response: ...

    def generate(self, prompt: str, system_prompt: str | None = None, max_tokens: int | None = None, temperature: float | None = None) -> str: ...


def usage_of(prompt: int | None, completion: int | None) -> dict:
    prompt, completion = prompt or 0, completion or 0
    return {"prompt_tokens": prompt, "completion_tokens": completion, "total_tokens": prompt + completion}


class Base:
    """generate() over chat(); zero tokens mean the default, a temperature of zero is kept."""

    max_tokens, temperature, timeout = 1000, 0.7, 60

    def limits(self, max_tokens, temperature) -> tuple:
        return max_tokens or self.max_tokens, self.temperature if temperature is None else temperature

    def generate(self, prompt, system_prompt=None, max_tokens=None, temperature=None) -> str:
        messages = [Message("system", system_prompt)] if system_prompt else []
        return self.chat([*messages, Message("user", prompt)], max_tokens, temperature).content

    def post(self, url: str, headers: dict | None, body: dict) -> dict:
        import requests

        try:
            found = requests.post(url, headers=headers, json=body, timeout=self.timeout)
        except requests.RequestException as error:
            raise ClientError(f"request to {url} failed: {error}") from error
        if found.status_code != 200:
            raise ClientError(f"status {found.status_code}: {found.text}")
        try:
            return found.json()
        except ValueError as error:
            raise ClientError(f"no JSON in the response: {error}") from error


def plain(messages: list) -> list:
    return [{"role": m.role, "content": m.content} for m in messages]


class SignedClient(Base):
    """Each request is signed with HMAC-SHA-256 over key, id, time and body."""

    def __init__(self, api_key: str, api_secret: str, base_url: str, top_p: float = 1.0, frequency_penalty: float = 0.0, presence_penalty: float = 0.0):
        if not (api_key and api_secret and base_url):
            raise ValueError("key, secret and base address are needed")
        self.api_key, self.api_secret, self.base_url = api_key, api_secret, base_url.rstrip("/")
        self.shape = {"top_p": top_p, "frequency_penalty": frequency_penalty, "presence_penalty": presence_penalty}

    @classmethod
    def from_env(cls) -> SignedClient:
        get = os.environ.get
        return cls(get("LLM_API_KEY", ""), get("LLM_API_SECRET", ""), get("LLM_BASE_URL", ""))

    def signature(self, body: dict, stamp: float, request_id) -> str:
        message = f"{self.api_key}{request_id}{stamp}{json.dumps(body)}"
        return base64.b64encode(hmac.new(self.api_secret.encode(), message.encode(), hashlib.sha256).digest()).decode()

    def body(self, messages: list, max_tokens=None, temperature=None) -> dict:
        most, heat = self.limits(max_tokens, temperature)
        return {"messages": plain(messages), **self.shape, "max_tokens": most, "temperature": heat, "n": 1, "response_format": {"type": "text"}, "stream": False}

    def chat(self, messages, max_tokens=None, temperature=None) -> Response:
        body, stamp, name = self.body(messages, max_tokens, temperature), time.time() * 1000, uuid.uuid4()
        headers = {"api-key": self.api_key, "Client-Request-Id": str(name), "Timestamp": str(stamp), "Authorization": self.signature(body, stamp, name), "Accept": "application/json", "Content-Type": "application/json"}
        data = self.post(f"{self.base_url}/chat/completions", headers, body)
        try:
            return Response(data["choices"][0]["message"]["content"], data.get("model"), data.get("usage"), data)
        except (KeyError, IndexError, TypeError) as error:
            raise ClientError(f"unexpected response: {error}") from error


class OpenAIClient(Base):
    def __init__(self, api_key: str | None = None, model: str | None = None, client=None):
        self.api_key, self.model, self._client = api_key or os.environ.get("OPENAI_API_KEY"), model or os.environ.get("OPENAI_MODEL", "gpt-4o-mini"), client
        if not self.api_key and client is None:
            raise ValueError("OPENAI_API_KEY is not set")

    def chat(self, messages, max_tokens=None, temperature=None) -> Response:
        most, heat = self.limits(max_tokens, temperature)
        try:
            if self._client is None:
                from openai import OpenAI

                self._client = OpenAI(api_key=self.api_key, timeout=self.timeout)
            found = self._client.chat.completions.create(model=self.model, messages=plain(messages), max_tokens=most, temperature=heat)
        except Exception as error:
            raise ClientError(f"the request failed: {error}") from error
        use = usage_of(found.usage.prompt_tokens, found.usage.completion_tokens) if found.usage else None
        return Response(found.choices[0].message.content or "", found.model, use)


class AnthropicClient(Base):
    """The system message travels beside the others."""

    def __init__(self, api_key: str | None = None, model: str | None = None, client=None):
        self.api_key, self.model, self._client = api_key or os.environ.get("ANTHROPIC_API_KEY"), model or os.environ.get("ANTHROPIC_MODEL", "claude-3-5-sonnet-20241022"), client
        if not self.api_key and client is None:
            raise ValueError("ANTHROPIC_API_KEY is not set")

    def chat(self, messages, max_tokens=None, temperature=None) -> Response:
        most, heat = self.limits(max_tokens, temperature)
        system = [m.content for m in messages if m.role == "system"][-1:]
        more = {"system": system[0]} if system and system[0] else {}
        try:
            if self._client is None:
                from anthropic import Anthropic

                self._client = Anthropic(api_key=self.api_key, timeout=self.timeout)
            found = self._client.messages.create(model=self.model, messages=plain([m for m in messages if m.role != "system"]), max_tokens=most, temperature=heat, **more)
        except Exception as error:
            raise ClientError(f"the request failed: {error}") from error
        use = usage_of(found.usage.input_tokens, found.usage.output_tokens) if found.usage else None
        return Response(found.content[0].text if found.content else "", found.model, use)


class OllamaClient(Base):
    timeout = 120

    def __init__(self, base_url: str | None = None, model: str | None = None):
        self.base_url = (base_url or os.environ.get("OLLAMA_BASE_URL", "http://localhost:11434")).rstrip("/")
        self.model = model or os.environ.get("OLLAMA_MODEL", "llama3.2")

    def body(self, messages, max_tokens=None, temperature=None) -> dict:
        most, heat = self.limits(max_tokens, temperature)
        return {"model": self.model, "messages": plain(messages), "stream": False, "options": {"num_predict": most, "temperature": heat}}

    def chat(self, messages, max_tokens=None, temperature=None) -> Response:
        data = self.post(f"{self.base_url}/api/chat", None, self.body(messages, max_tokens, temperature))
        if "content" not in data.get("message", {}):
            raise ClientError("unexpected response: no message content")
        use = usage_of(data.get("prompt_eval_count"), data.get("eval_count")) if {"eval_count", "prompt_eval_count"} & set(data) else None
        return Response(data["message"]["content"], data.get("model"), use, data)

    def _tags(self) -> dict:
        import requests

        try:
            found = requests.get(f"{self.base_url}/api/tags", timeout=5)
            found.raise_for_status()
            return found.json()
        except (requests.RequestException, ValueError) as error:
            raise ClientError(f"no answer from {self.base_url}: {error}") from error

    def is_available(self) -> bool:
        try:
            self._tags()
        except ClientError:
            return False
        return True

    def list_models(self) -> list:
        return [m["name"] for m in self._tags().get("models", [])]


class EchoClient(Base):
    """Answers with the last message, for tests and dry runs."""

    def chat(self, messages, max_tokens=None, temperature=None) -> Response:
        return Response(messages[-1].content, "echo", usage_of(sum(len(m.content.split()) for m in messages), len(messages[-1].content.split())))


PROVIDERS = {"custom": SignedClient.from_env, "openai": OpenAIClient, "anthropic": AnthropicClient, "ollama": OllamaClient, "echo": EchoClient}


def create(provider: str | None = None) -> Client:
    """The argument, else LLM_PROVIDER, else custom."""
    name = (provider or os.environ.get("LLM_PROVIDER", "custom")).lower().strip()
    if name not in PROVIDERS:
        raise ProviderError(f"unknown provider '{name}'; known: {', '.join(sorted(PROVIDERS))}")
    try:
        return PROVIDERS[name]()
    except ValueError as error:
        raise ProviderError(f"provider {name}: {error}") from error
