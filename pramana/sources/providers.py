"""Models that answer prompts: behind an HTTP interface of chat completions, or local ones whose packages are opened on first use."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request


class ProviderError(RuntimeError):
    """A model couldn't be asked."""


class ChatCompletions:
    """A server with the common interface ``{base_url}/chat/completions``. Busy and failing servers are asked again, after as long as they say, 20 s at most."""

    def __init__(self, *, base_url: str, model: str, api_key: str, max_tokens: int = 320, timeout: float = 60.0, retries: int = 3):
        if not api_key:
            raise ProviderError("no key")
        self.base_url, self.model, self.api_key, self.max_tokens, self.timeout, self.retries = base_url.rstrip("/"), model, api_key, max_tokens, timeout, retries
        self.name = f"api:{model}"

    def complete(self, prompts: list[str]) -> list[str]:
        return [self._ask(p) for p in prompts]

    def _ask(self, prompt: str) -> str:
        body = json.dumps({"model": self.model, "temperature": 0, "max_tokens": self.max_tokens, "messages": [{"role": "user", "content": prompt}]}).encode()
        for left in range(self.retries, -1, -1):
            request = urllib.request.Request(f"{self.base_url}/chat/completions", data=body, method="POST", headers={"Content-Type": "application/json", "Authorization": f"Bearer {self.api_key}"})
            try:
                with urllib.request.urlopen(request, timeout=self.timeout) as answer:  # noqa: S310 - the caller's address
                    return (json.load(answer)["choices"][0]["message"]["content"] or "").strip()
            except urllib.error.HTTPError as e:
                if not left or e.code not in (429, 500, 502, 503, 504):
                    raise ProviderError(f"{self.name}: HTTP {e.code}") from None
                said = (e.headers or {}).get("Retry-After", "")
                wait = float(said) if said.replace(".", "", 1).isdigit() else 2.0 ** (self.retries - left)
            except urllib.error.URLError as e:
                if not left:
                    raise ProviderError(f"{self.name}: {e.reason}") from None
                wait = 2.0 ** (self.retries - left)
            time.sleep(min(wait, 20.0))
        raise AssertionError


class LocalTransformers:
    """A causal model of the transformers package, one a worker process."""

    def __init__(self, model: str, *, max_tokens: int = 320):
        self.model, self.max_tokens, self.name, self._pipe = model, max_tokens, f"local:{model}", None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_pipe": None}

    def complete(self, prompts: list[str]) -> list[str]:
        if self._pipe is None:
            try:
                from transformers import pipeline
            except ImportError as e:
                raise ProviderError("the package transformers isn't installed") from e
            self._pipe = pipeline("text-generation", model=self.model)
        return [r[0]["generated_text"].strip() for r in self._pipe(prompts, max_new_tokens=self.max_tokens, do_sample=False, return_full_text=False)]


class LocalLlama:
    """A model file for llama.cpp, one a worker process; with ``schema`` its replies are objects of that JSON schema."""

    def __init__(self, path: str, *, max_tokens: int = 320, context: int = 4096, schema: dict | None = None):
        self.path, self.max_tokens, self.context, self.schema, self.name, self._model = path, max_tokens, context, schema, f"local:{path.rsplit('/', 1)[-1]}", None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_model": None}

    def complete(self, prompts: list[str]) -> list[str]:
        if self._model is None:
            try:
                from llama_cpp import Llama
            except ImportError as e:
                raise ProviderError("the package llama_cpp isn't installed") from e
            self._model = Llama(self.path, n_ctx=self.context, verbose=False)
        form = {"type": "json_object", **({"schema": self.schema} if self.schema else {})}
        return [self._model.create_chat_completion([{"role": "user", "content": p}], temperature=0, max_tokens=self.max_tokens, response_format=form)["choices"][0]["message"]["content"].strip() for p in prompts]


class CrossEncoderNLI:
    """Entailment, neutral and contradiction of pairs by a sequence classifier whose configuration names the labels, one a worker process."""

    def __init__(self, model: str, *, max_length: int = 384):
        self.model, self.max_length, self.name, self._parts = model, max_length, model, None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_parts": None}

    def score(self, pairs: list[tuple[str, str]]) -> list[tuple[float, float, float]]:
        """A pair with an empty side is neutral."""
        asked = [(i, p) for i, p in enumerate(pairs) if all(x and x.strip() for x in p)]
        out = [(0.0, 1.0, 0.0)] * len(pairs)
        if not asked:
            return out
        if self._parts is None:
            try:
                import torch
                from transformers import AutoModelForSequenceClassification, AutoTokenizer
            except ImportError as e:
                raise ProviderError("the packages torch and transformers aren't installed") from e
            model = AutoModelForSequenceClassification.from_pretrained(self.model).eval()
            order = {str(v).lower(): int(k) for k, v in model.config.id2label.items()}
            self._parts = torch, AutoTokenizer.from_pretrained(self.model), model, [order[x] for x in ("entailment", "neutral", "contradiction")]
        torch, tokenizer, model, order = self._parts
        with torch.no_grad():
            logits = model(**tokenizer([p[0] for _, p in asked], [p[1] for _, p in asked], truncation=True, max_length=self.max_length, padding=True, return_tensors="pt")).logits
        for (i, _), row in zip(asked, torch.softmax(logits, -1).tolist()):
            out[i] = tuple(row[k] for k in order)
        return out
