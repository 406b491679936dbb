"""Places where a text may be cut, by strength. Shared by splitting and sentence work."""

from __future__ import annotations

import re

#: White space of any kind, and what ends a sentence, with closing marks.
PARAGRAPH = re.compile(r"(?:\r?\n[^\S\n]*){2,}| ")
LINE = re.compile(r"\r?\n")
SENTENCE = re.compile(r"[.!?…؟۔։]+[\"'”’»)\]]*\s+|[。\uff01\uff1f。।॥]+[\"'”’»」』)\]]*\s*")
WORD = re.compile(r"\s+")
#: Letters without spaces between words: a cut between two of them is no worse than elsewhere, but not inside a cluster.
JOINER = re.compile(r"[̀-ͯ҃-҉֑-ֽً-ٰٟऀ-ःऺ-ॏ॑-ॗॢॣัิ-ฺ็-๎‌‍⃐-⃿︀-️\U0001f3fb-\U0001f3ff\U000e0100-\U000e01ef]")


def clusters_break(text: str, at: int) -> bool:
    """Whether a cut before ``text[at]`` keeps combining marks, joined emoji and CR LF together."""
    if at <= 0 or at >= len(text):
        return True
    return not (JOINER.match(text[at]) or text[at - 1] in "‍" or text[at - 1 : at + 1] == "\r\n" or ("\U0001f1e6" <= text[at - 1] <= "\U0001f1ff" and "\U0001f1e6" <= text[at] <= "\U0001f1ff"))
