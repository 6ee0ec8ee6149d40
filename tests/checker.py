"""Independent line-by-line checker used to verify the DataFrame detection."""

import hashlib
import math
import re

from leakloom import catalog


def entropy(text):
    counts = {}
    for char in text:
        counts[char] = counts.get(char, 0) + 1
    return sum(-n / len(text) * math.log2(n / len(text)) for n in counts.values())


def high_entropy(text):
    low = text.lower()
    if len(text) < 20 or any(word in low for word in catalog.ENTROPY_STOP_WORDS):
        return False
    return len(set(text)) >= len(text) * 0.3 and round(entropy(text), 12) >= 4.5


def hits(line, patterns=catalog.BUILTIN_PATTERNS):
    """(pattern name, hash) of every expected hit in one line."""
    found = []
    for p in patterns:
        for match in re.finditer(p.pattern, line, re.IGNORECASE):
            found.append((p.name, match.group(1) if match.groups() else match.group(0)))
    for shape in catalog.ENTROPY_SHAPES:
        for match in re.finditer(shape, line):
            if high_entropy(match.group(1)):
                found.append((catalog.ENTROPY_NAME, match.group(1)))
    return sorted((name, hashlib.sha256(value.encode()).hexdigest()[:16]) for name, value in found)
