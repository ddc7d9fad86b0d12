"""Small models in plain Python, written from the rules, to compare the Spark jobs with."""

import re


def batch_numbers(tokens: list[int], max_tokens: int, max_items: int) -> list[int]:
    numbers, batch, held, items = [], 0, 0, 0
    for count in tokens:
        if items and (held + count > max_tokens or items == max_items):
            batch, held, items = batch + 1, 0, 0
        held, items = held + count, items + 1
        numbers.append(batch)
    return numbers


def diff_lines(patch: str) -> set[int]:
    found, line = set(), None
    for piece in patch.split("\n"):
        head = re.match(r"@@ -\d+(?:,\d+)? \+(\d+)(?:,\d+)? @@", piece)
        if head:
            line = int(head[1])
        elif line is not None and not re.match(r"-(?!--)", piece):
            found.add(line)
            line += 1
    return found


def windows(count: int, size: int, overlap: int) -> list[tuple[int, int]]:
    spans, first = [], 1
    while True:
        last = min(first + size - 1, count)
        spans.append((first, last))
        if last == count:
            return spans
        first += max(1, size - overlap)


def context_text(similar: list[dict], related: list[dict], max_chars: int) -> str:
    def piece(chunk, limit):
        title = f"### {chunk['file_path']}:{chunk['start_line']}" + (f" ({chunk['name']})" if chunk["name"] else "")
        if "score" in chunk:
            title += f" [similarity: {chunk['score']:.2f}]"
        body = chunk["content"] if len(chunk["content"]) <= limit else chunk["content"][:limit] + "\n# ... (truncated)"
        return f"{title}\n```\n{body}\n```\n"

    used, parts = 0, []
    first = [piece(c, 400) for c in similar[:3] if c["score"] >= 0.5]
    taken = []
    for text in first:
        if used + len(text) > max_chars * 0.7:
            break
        taken.append(text)
        used += len(text)
    if taken:
        parts.append("## Similar Code in Codebase\n" + "".join(taken))
    if used < max_chars * 0.9:
        taken = []
        for text in [piece(c, 300) for c in related[:2]]:
            if used + len(text) > max_chars:
                break
            taken.append(text)
            used += len(text)
        if taken:
            parts.append("## Related Code\n" + "".join(taken))
    return "\n".join(parts)
