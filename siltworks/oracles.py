"""Parts of DuckDB SQL that several queries' oracles share."""

from __future__ import annotations

from siltworks.registry import lit


def marked(regex: str, flags: str = "g") -> str:
    """``body`` cut at a mark before each match, with another mark after it."""
    return f"string_split(regexp_replace(body, {lit('(' + regex + ')')}, chr(57344) || '\\1' || chr(57345), '{flags}'), chr(57344))"


def positions(regex: str, source: str, flags: str = "g") -> str:
    """key, m, line (from 1), col (from 0) of each match in ``source`` (key, body); texts must not have the two marks, which are of a private range."""
    return (
        f"SELECT key, m, length(before) - length(replace(before, chr(10), '')) + 1 AS line, length(string_split(before, chr(10))[-1]) AS col FROM (SELECT key, string_split(parts[i], chr(57345))[1] AS m, replace(array_to_string(parts[1:i - 1], ''), chr(57345), '') AS before "
        f"FROM (SELECT key, parts, unnest(generate_series(2, len(parts))) AS i FROM (SELECT key, {marked(regex, flags)} AS parts FROM ({source}))))"
    )
