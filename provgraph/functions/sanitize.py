"""Redaction for export (SAN): home paths, media file names, and every string leaf of a JSON document."""

from __future__ import annotations

import hashlib
import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Endings of media and project files, the shape of a bare path, and the patterns of personal locations.
MEDIA = (
    "wav", "wave", "aif", "aiff", "aifc", "flac", "mp3", "m4a", "aac", "ogg", "oga", "opus", "caf", "rex", "rx2",
    "rpp", "als", "adg", "logicx", "dawproject", "cpr", "npr", "song", "flp", "ptx", "ptf",
    "mid", "midi", "mov", "mp4", "m4v", "wmv",
)
PATH_SHAPE = r"(?:/|\./|\.\./|~/|~$|[A-Za-z]:[\\/])"
HOMES = (r"/Users/[^/\s\"']+", r"/home/[^/\s\"']+", r"\\Users\\[^\\\s\"']+", r"/Volumes/[^/\s\"']+")
REDACTED = "<redacted>"
MEDIA_TOKEN = rf"[\w./\\-]+\.(?:{'|'.join(MEDIA)})\b"


def redact_paths(text: Column, users: tuple[str, ...] = ()) -> Column:
    """Home directories, volumes and the given user names replaced."""
    for pattern in (*HOMES, *(rf"\b{re.escape(u)}\b" for u in users)):
        text = F.regexp_replace(text, pattern, REDACTED)
    return text


def hash_asset(path: Column) -> Column:
    return F.concat(F.lit("asset:sha256:"), F.substring(F.sha2(path, 256), 1, 12))


def is_asset(text: Column) -> Column:
    """A string that as a whole is a media or project file, or a bare path."""
    bare = F.regexp_replace(text, r"^\s+|\s+$", "")
    return bare.rlike(rf"(?i)\.(?:{'|'.join(MEDIA)})$") | bare.rlike(f"^{PATH_SHAPE}")


def sanitize_text(text: Column, users: tuple[str, ...] = ()) -> Column:
    """Locations redacted, then a media path as its hash, so that one file has one hash whoever's home it lies in; in other text each media token as its hash."""
    text = redact_paths(text, users)
    found = F.regexp_extract_all(text, F.lit(f"(?i){MEDIA_TOKEN}"), F.lit(0))
    inside = F.aggregate(found, text, lambda acc, m: F.replace(acc, m, hash_asset(m)))
    return F.when(is_asset(text), hash_asset(text)).otherwise(inside)


def sanitize_json(column: str, users: tuple[str, ...] = ()) -> Column:
    """Every key and string of a JSON document, at any depth; what isn't JSON becomes null. An Arrow UDF, for depth has no bound."""
    homes = [re.compile(p) for p in (*HOMES, *(rf"\b{re.escape(u)}\b" for u in users))]
    token, ending, shape = re.compile(f"(?i){MEDIA_TOKEN}"), re.compile(rf"(?i)\.(?:{'|'.join(MEDIA)})$"), re.compile(PATH_SHAPE)

    def hashed(m: str) -> str:
        return "asset:sha256:" + hashlib.sha256(m.encode()).hexdigest()[:12]

    def clean(x):
        if isinstance(x, dict):
            return {clean(k): clean(v) for k, v in x.items()}
        if isinstance(x, list):
            return [clean(v) for v in x]
        if not isinstance(x, str):
            return x
        for p in homes:
            x = p.sub(REDACTED, x)
        bare = x.strip()
        return hashed(x) if ending.search(bare) or shape.match(bare) else token.sub(lambda m: hashed(m[0]), x)

    @F.pandas_udf("string")
    def walk(values: pd.Series) -> pd.Series:
        def one(v):
            try:
                return None if v is None else json.dumps(clean(json.loads(v)), ensure_ascii=False, sort_keys=True)
            except ValueError:
                return None

        return values.map(one)

    return walk(column)
