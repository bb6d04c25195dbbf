"""Cuts of a text that no token crosses."""

import re
from collections.abc import Iterator

#: A white-space character (more than Unicode's White_Space, which is safe here) followed by a space.
_ODD = re.compile(r"\s ")
#: Characters of a long text handled at a time.
STRETCH = 1 << 20


def odd(text: str) -> bool:
    """Whether some space follows a white-space character, so that not every space is a place to cut."""
    return _ODD.search(text) is not None


def chunks(text: str) -> list[str]:
    """``text`` cut before spaces that follow a character that is not white space.

    The patterns of byte-level tokenizers put a space only at the start of a match or into a run of white space, so a
    run of white space always starts a match: tokens of the chunks are the tokens of the text. Joined, the chunks give
    the text.
    """
    if odd(text):
        parts = re.split(r"(?<=\S)(?= )", text)
    else:
        parts = text.split(" ")
        parts[1:] = [" " + p for p in parts[1:]]
        if not parts[0]:
            del parts[0]
    return parts


def stretches(text: str) -> Iterator[str]:
    """``text`` in stretches of about STRETCH characters, cut where ``chunks`` may cut."""
    start, n = 0, len(text)
    while n - start > STRETCH:
        end = start + STRETCH
        while end < n and not (text[end] == " " and not text[end - 1].isspace()):
            end += 1
        yield text[start:end]
        start = end
    yield text[start:]
