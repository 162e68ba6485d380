"""Fixed values of the text rules: patterns and character tables, in order."""

from __future__ import annotations

#: Whole-line page numbers (Python dialect).
PAGE_NUMBERS = [
    r"^\s*Page\s+\d+\s*$",
    r"^\s*page\s+\d+\s*$",
    r"^\s*-\s*\d+\s*-\s*$",
    r"^\s*\[\s*\d+\s*\]\s*$",
    r"^\s*\d+\s+of\s+\d+\s*$",
    r"^\s*\d+\s*/\s*\d+\s*$",
    r"^\s*\(\s*\d+\s*\)\s*$",
    r"^\s*p\.\s*\d+\s*$",
    r"^\s*pg\.\s*\d+\s*$",
]

#: Whole-line boilerplate (Python dialect).
BOILERPLATE = [
    r"(?i)^\s*confidential\s*$",
    r"(?i)^\s*proprietary\s*(and\s+)?confidential\s*$",
    r"(?i)^\s*strictly\s+confidential\s*$",
    r"(?i)^\s*for\s+internal\s+use\s+only\s*$",
    r"(?i)^\s*internal\s+use\s+only\s*$",
    r"(?i)^\s*not\s+for\s+(public\s+)?distribution\s*$",
    r"(?i)^\s*draft\s*$",
    r"(?i)^\s*draft\s+version\s*$",
    r"(?i)^\s*working\s+draft\s*$",
    r"(?i)^\s*do\s+not\s+distribute\s*$",
    r"(?i)^\s*do\s+not\s+copy\s*$",
    r"(?i)^\s*do\s+not\s+forward\s*$",
    r"(?i)^\s*all\s+rights\s+reserved\.?\s*$",
    r"(?i)^\s*copyright\s*(?:©|\(c\))?\s*\d{4}.*$",
    r"^\s*©\s*\d{4}.*$",
    r"(?i)^\s*\(c\)\s*\d{4}.*$",
    r"(?i)^\s*disclaimer\s*:?\s*$",
    r"(?i)^\s*legal\s+notice\s*:?\s*$",
]

#: Typographic characters and what replaces them, pairwise.
SPECIAL_FROM = "“”‘’«»„‚–—―−     "
SPECIAL_TO = "\"\"''\"\"\"'----     "

#: The subset that basic cleaning replaces.
BASIC_FROM = "“”‘’–—"
BASIC_TO = "\"\"''--"

#: Bullets, all of which become "-".
BULLETS = "•‣⁃⁌⁍∙▪▫●○◦■□➤"

#: Invisible characters, all of which are removed.
ZERO_WIDTH = "​‌‍﻿⁠­"

#: The 27 characters in which windows-1252 differs from iso-8859-1 (bytes 0x80 to 0x9f; five are undefined).
CP1252_BYTES = "\x80\x82\x83\x84\x85\x86\x87\x88\x89\x8a\x8b\x8c\x8e\x91\x92\x93\x94\x95\x96\x97\x98\x99\x9a\x9b\x9c\x9e\x9f"
CP1252_CHARS = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"
CP1252_UNDEFINED = "\x81\x8d\x8f\x90\x9d"
