"""What of a text counts for its language: words, after repair of encodings and without what isn't prose."""

from __future__ import annotations

import html
import re
import unicodedata

import regex

LINE = re.compile(r"\r\n|[\n\r]")
#: Patterns have no bounds on what they match; possessive runs and starts at borders keep them linear.
ADDRESS = regex.compile(r"(?<![a-z0-9+.-])[a-z][a-z0-9+.-]*+://\S*+|\bwww\.\S++|(?<!\S)[^\s@]++@\S++", regex.I)
TAG = regex.compile(r"<[!/?]?[A-Za-z][^<>\n]*+>")
#: A line of parts of so many words at most with these signs between them is navigation.
MENU, MENU_WORDS = re.compile(r"\s[·•]\s|\|"), 3
#: Lines without any of these have no code.
CODE_HINT = re.compile(r"[{}\[\]=;<>]")
BLOCK = regex.compile(r"\{[^{}]*+\}")
#: A piece of code: braces, an index, an assignment or comparison, an arrow, a statement's end inside.
CODE_PIECE = re.compile(r"[{}=<>]|\w\[|\]\w|[(\[]\w*\[|;\S|^;$|\d;$|[)\]];$")
ODD_SIGN = re.compile(r"[\d/\\_=+]")
PARTS = re.compile(r"[\s,;]+")
SIGNS, FIGURE, LETTER = re.compile(r"[/\\_=+]"), re.compile(r"\d"), re.compile(r"[^\W\d_]")
# Units, which after a number belong to it.
UNIT = regex.compile(r"\d[^\S\r\n]?(?:km|cm|mm|m|kg|mg|g|ms|s|h|min|kb|mb|gb|tb|l|ml|am|pm|eur|usd|px|pt)\b", regex.I)
ENTITY = regex.compile(r"&(?:#\d{1,7}|#x[0-9a-f]{1,6}|[a-z]{2,31});", regex.I)
WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
NO_LETTERS = {c: " " for c in range(128) if not chr(c).isalpha() and chr(c) != "'"}
UNSEEN = regex.compile(r"(?V1)[[\p{Cf}\p{Cc}\p{So}\p{No}\p{Mn}\p{Co}\p{Cn}ªº]--[\x00-\x7f]]")
LATIN_TAIL = {ord(bytes([b]).decode("cp1252")): b for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}
LEAD_AND_TAIL = re.compile("[\xc2-\xf4][\x80-\xbf" + "".join(map(chr, LATIN_TAIL)) + "]")
TWICE_ENCODED = regex.compile("[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}")


def decode_once_more(text: str) -> str:
    """Undo UTF-8 that was read as Latin-1 or Windows-1252, wherever a whole character's bytes stand."""
    flat = text.translate(LATIN_TAIL)
    out, last = [], 0
    for m in TWICE_ENCODED.finditer(flat):
        try:
            made = m[0].encode("latin-1").decode("utf-8")
        except UnicodeDecodeError:
            continue
        out += [text[last : m.start()], made]
        last = m.end()
    return "".join(out) + text[last:] if out else text


def repaired(text: str) -> str:
    """Entities and twice encoded characters resolved, marks composed, ligatures split, invisible signs and symbols gone."""
    if "&" in text:
        text = ENTITY.sub(lambda m: html.unescape(m[0]), text)
    if text.isascii():
        return text
    if LEAD_AND_TAIL.search(text):
        text = decode_once_more(text)
    return unicodedata.normalize("NFKC", UNSEEN.sub("", unicodedata.normalize("NFC", text)))


def without_comments(text: str) -> str:
    """Without <!-- ... --> of any length; one that isn't closed stays."""
    out, last = [], 0
    while (start := text.find("<!--", last)) >= 0 and (end := text.find("-->", start + 4)) >= 0:
        out += [text[last:start], " "]
        last = end + 3
    return "".join(out) + text[last:] if out else text


def split_words(line: str) -> list[str]:
    """Runs of letters, joined by single apostrophes."""
    if line.isascii() and "''" not in line:
        words = line.translate(NO_LETTERS).split()
        return [w for w in (w.strip("'") for w in words) if w] if "'" in line else words
    return WORD.findall(line)


def is_menu(line: str) -> bool:
    """Two or more short parts with bars or dots between them, as navigation in any language has them."""
    parts = [p for p in MENU.split(line) if p.strip()]
    return len(parts) > 1 and all(len(p.split()) <= MENU_WORDS for p in parts)


def without_code(line: str) -> str:
    """A line without its pieces of code; nothing of it if they are half of its pieces or more."""
    pieces = BLOCK.sub(" {} ", line).split()
    prose = [p for p in pieces if not CODE_PIECE.search(p)]
    return " ".join(prose) if 2 * len(prose) > len(pieces) else ""


def is_blob(piece: str) -> bool:
    """A digest, an encoded block, a path, a name with figures."""
    return len(SIGNS.findall(piece)) > 1 or bool(FIGURE.search(piece) and LETTER.search(piece))


def words_of(paragraph: str) -> list[str]:
    """Lower-case words of prose, in order. Code, menus, addresses, tags and blobs give none.

    What is left out is told by how it looks, never by its length. Takes time in proportion to the text.
    """
    text = repaired(paragraph)
    if "://" in text or "@" in text or "www." in text:
        text = ADDRESS.sub(" ", text)
    if "<" in text:
        text = TAG.sub(" ", without_comments(text))
    out: list[str] = []
    for line in LINE.split(text):
        if is_menu(line):
            continue
        if CODE_HINT.search(line):
            line = without_code(line)
        if ODD_SIGN.search(line):
            line = UNIT.sub(" ", line)
            pieces = PARTS.split(line)
            if any(is_blob(p) for p in pieces if not p.isalpha()):
                prose = [p for p in pieces if not is_blob(p)]
                if len(pieces) - len(prose) >= max(3, len(prose)):
                    continue  # what is left of it may be a digest without figures
                line = " ".join(prose)
        out += split_words(line.lower())
    return out


def paragraphs_of(text: str) -> list[str]:
    """Parts of a text between lines that are empty or hold white space only; numbered by their place."""
    parts, held = [], []
    for line in LINE.split(text):
        if line and not line.isspace():
            held.append(line)
        elif held:
            parts.append("\n".join(held))
            held = []
    if held:
        parts.append("\n".join(held))
    return parts
