"""A chat model behind an OpenAI-compatible address, without retries."""

from __future__ import annotations

import json
import os
from urllib.request import Request, urlopen

from . import settings as S


def call_model(prompt: str, *, json_output: bool = False) -> str:
    """The reply to a prompt; address, key and model come from the environment."""
    if not prompt.strip():
        raise ValueError("the prompt is empty")
    key, url, model = (os.environ.get(x, "") for x in (S.KEY_ENV, S.URL_ENV, S.MODEL_ENV))
    if not key or not url or not model:
        raise RuntimeError(f"set {S.KEY_ENV}, {S.URL_ENV} and {S.MODEL_ENV}")
    body = {"model": model, "messages": [{"role": "user", "content": prompt}], "temperature": 0, "max_tokens": S.OUTPUT_TOKENS}
    if json_output:
        body["response_format"] = {"type": "json_object"}
    ask = Request(url.rstrip("/") + "/chat/completions", json.dumps(body).encode(), {"Authorization": f"Bearer {key}", "Content-Type": "application/json"})
    with urlopen(ask, timeout=S.TIMEOUT_SECONDS) as got:
        return json.load(got)["choices"][0]["message"]["content"] or ""
