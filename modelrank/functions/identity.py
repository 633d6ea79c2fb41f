"""Canonical JSON and content hashes: what makes two configurations the same."""

from __future__ import annotations

import hashlib
import json
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical(config: dict[str, Any], drop: tuple[str, ...] = ()) -> str:
    """A configuration as text: keys in order, null and empty ones left out."""

    def clean(x: Any) -> Any:
        if isinstance(x, dict):
            return {k: clean(v) for k, v in sorted(x.items()) if k not in drop and v not in (None, "", [], {})}
        return [clean(v) for v in x] if isinstance(x, (list, tuple)) else x

    return json.dumps(clean(config), separators=(",", ":"), ensure_ascii=False)


def content_hash(*parts: Any) -> str:
    """Hash of canonical texts and nested lists of them, in order."""
    return hashlib.sha256(json.dumps(parts, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def inference_hash(reader: dict, model: dict) -> str:
    """Batch size, id and information about a model don't count."""
    return content_hash(canonical(reader, ("other_features",)), canonical(model, ("info", "batch_size", "id")))


def mutable_hash(reader: dict, model: dict, changes: list[tuple[dict, list[int], list[int]]]) -> str:
    return content_hash(inference_hash(reader, model), [[inference_hash(r, model), base, other] for r, base, other in changes])


def classifier_hash(classifier: str, train: list[str], test: list[str]) -> str:
    return content_hash(classifier, train, test)


def json_of(**columns: Column) -> Column:
    """Canonical JSON of columns: keys in order, nulls left out."""
    return F.to_json(F.struct(*[columns[k].alias(k) for k in sorted(columns)]))


def hash_of(*texts: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", *texts), 256)
