"""Reading public vocabulary files on the driver; the small tables travel to tasks as broadcasts."""

from __future__ import annotations

import base64
import json


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(moved)}


def ranks_from_json(path: str) -> dict[bytes, int]:
    """Token bytes and ids of a byte-level BPE file, where an id is also the rank of its merge."""
    with open(path, encoding="utf-8") as file:
        content = json.load(file)
    special = {x["content"] for x in content.get("added_tokens", [])}
    alphabet = byte_alphabet()
    return {
        bytes(alphabet[c] for c in token): number
        for token, number in content["model"]["vocab"].items()
        if token not in special
    }


def added_tokens(path: str) -> dict[str, int]:
    """Tokens of a byte-level BPE file that are matched in a text as they stand, before it is cut into words."""
    with open(path, encoding="utf-8") as file:
        added = json.load(file).get("added_tokens", [])
    if any(x.get(flag) for x in added for flag in ("lstrip", "rstrip", "single_word", "normalized")):
        raise ValueError("added tokens that take in blanks, or only whole or changed words, are not supported")
    return {x["content"]: x["id"] for x in added}


def ranks_from_tiktoken(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}
