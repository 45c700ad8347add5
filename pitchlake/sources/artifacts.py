"""Model artifacts: canonical JSON with a digest; loading fails on any mismatch."""

from __future__ import annotations

import hashlib
import json


def dumps(model: dict, version: str) -> str:
    """Floats are written in their shortest exact form, keys sorted, so a round trip keeps the digest."""
    body = json.dumps({"model": model, "version": version}, sort_keys=True, separators=(",", ":"), allow_nan=False)
    return json.dumps({"sha256": hashlib.sha256(body.encode()).hexdigest(), "body": body})


def loads(text: str, version: str) -> dict:
    bundle = json.loads(text)
    if hashlib.sha256(bundle["body"].encode()).hexdigest() != bundle["sha256"]:
        raise ValueError("the artifact's digest does not match its content")
    body = json.loads(bundle["body"])
    if body["version"] != version:
        raise ValueError(f"the artifact has version {body['version']!r}, not {version!r}")
    return body["model"]
