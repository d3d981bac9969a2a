"""Chat exports and plain files to transcripts.

The format is decided per file: by its extension, then by what the JSON holds. An array whose first message has
a role is a role transcript, one whose first message has a user or text is a team chat, an object with a
``mapping`` is a tree of messages; anything else is taken as it stands.

Defined results: null content is the empty text; a message field of another type than text makes the whole
array plain text; blank, broken and role-less lines of a line file are dropped; of several roots of a tree the
smallest id is taken, and a node that was visited is not visited again.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memlake.functions import text as X

_FIELDS = ("role", "content", "user", "text")


def _field(v: Column, name: str) -> Column:
    return F.coalesce(F.try_variant_get(v, f"$.{name}", "string"), F.lit(""))


def _textual(v: Column) -> Column:
    """Whether a message is an object whose known fields are texts or null."""
    ok = F.schema_of_variant(v).startswith("OBJECT")
    for name in _FIELDS:
        ok = ok & F.coalesce(F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant")), F.lit("VOID")).isin("STRING", "VOID")
    return ok


def _joined(lines: Column) -> Column:
    return F.array_join(lines, "\n")


@F.pandas_udf(T.StringType())
def tree_transcript(mapping: pd.Series) -> pd.Series:
    """The messages of a tree, depth first through all children; the mapping itself if it is no tree."""

    def one(raw):
        if raw is None:
            return None
        try:
            nodes = json.loads(raw)
            roots = sorted(k for k, n in nodes.items() if not n.get("parent"))
            lines, stack, seen = [], roots[:1], set()
            while stack:
                at = stack.pop()
                if at in seen or at not in nodes:
                    continue
                seen.add(at)
                message = nodes[at].get("message") or {}
                role = (message.get("author") or {}).get("role")
                for part in (message.get("content") or {}).get("parts") or []:
                    if isinstance(part, str) and part.strip() and role in ("user", "assistant"):
                        lines.append(f"> {role}: {part}" if role == "user" else f"{role}: {part}")
                stack += reversed(nodes[at].get("children") or [])
            return "\n".join(lines)
        except (ValueError, AttributeError, TypeError):
            return raw

    return mapping.map(one, na_action="ignore").astype(object)


def json_transcript(content: Column) -> Column:
    """The transcript of a JSON export."""
    v = F.try_parse_json(content)
    messages = F.try_variant_get(v, "$", "array<variant>")
    good = F.coalesce((F.size(messages) > 0) & F.forall(messages, _textual), F.lit(False))
    first = F.get(messages, 0)
    roles = _joined(F.transform(F.filter(messages, lambda m: _field(m, "role") != ""), lambda m: X.message_line(_field(m, "role"), _field(m, "content"))))
    chat = _joined(F.transform(F.filter(messages, lambda m: _field(m, "text") != ""), lambda m: F.concat(F.when(_field(m, "user") != "", _field(m, "user")).otherwise("unknown"), F.lit(": "), _field(m, "text"))))
    mapping = F.try_variant_get(v, "$.mapping", "variant")
    tree = F.when(mapping.isNotNull(), F.to_json(mapping))
    return F.when(good & (_field(first, "role") != ""), roles).when(good & ((_field(first, "user") != "") | (_field(first, "text") != "")), chat).when(tree.isNotNull(), tree_transcript(tree)).otherwise(content)


def lines_transcript(content: Column) -> Column:
    """The transcript of a file with one JSON message a line."""
    parsed = F.transform(F.split(content, "\n"), lambda line: F.try_parse_json(X.trim_space(line)))
    good = F.filter(parsed, lambda m: m.isNotNull() & F.coalesce(_textual(m), F.lit(False)) & (_field(m, "role") != ""))
    return _joined(F.transform(good, lambda m: X.message_line(_field(m, "role"), _field(m, "content"))))


def transcripts(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """``files`` with the column ``transcript``, each read by its extension."""
    ext = F.lower(F.regexp_extract(F.col(path), r"(\.[^./]*)$", 1))
    text = F.coalesce(F.col(content), F.lit(""))
    trimmed = X.trim_space(text)
    out = F.when(trimmed == "", "").when(ext == ".json", json_transcript(text)).when(ext == ".jsonl", lines_transcript(text)).when(ext == ".txt", trimmed).otherwise(text)
    return files.withColumn("transcript", out)
