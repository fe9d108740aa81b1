"""SQL pieces that several queries share."""

FILES = "files AS (SELECT source || '/' || lang || '/' || doc_id || '.txt' AS path, text AS content FROM documents)"
LINES = FILES + ", lines AS (SELECT path, unnest(string_split(content, chr(10))) AS text, CAST(generate_subscripts(string_split(content, chr(10)), 1) AS INT) AS line_no FROM files)"


def with_lines(select: str, more: str = "") -> str:
    return f"WITH {LINES}{', ' + more if more else ''} {select}"
