"""One consistent form for text that looks the same.

The form is NFC in which, besides, widths and fonts of letters, kinds of blanks, look-alike letters of other
scripts and invisible characters are levelled. What a reader sees stays: letter case, sharp s, superscripts,
dotted and dotless i, line breaks, dashes, the number of blanks.

``MAP`` is built from the Unicode database by rule plus the look-alikes below; ``fold`` applies it to one string.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

# Letters of other scripts that look like a Latin letter, each pair as other letter, Latin letter.
LOOKALIKES = """
А A  В B  Е E  Ѕ S  І I  Ј J  К K  М M  Н H  О O  Р P  С C  Т T  У Y  Х X  Ԛ Q  Ԝ W
а a  е e  ѕ s  і i  ј j  о o  р p  с c  у y  х x  һ h  ԁ d  ԛ q  ԝ w
Α A  Β B  Ε E  Ζ Z  Η H  Ι I  Κ K  Μ M  Ν N  Ο O  Ρ P  Τ T  Υ Y  Χ X
ο o  ν v
"""

#: Kinds of compatibility forms whose letter or blank is only wider, narrower or in another font.
_SAME_LOOK = ("<wide>", "<narrow>", "<noBreak>", "<font>")

#: Format characters without a look of their own that are not of category Cf.
_INVISIBLE = [0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)]

_LINE_BREAKS = [0x0B, 0x0C, 0x85, 0x2028, 0x2029]


#: Where compatibility forms, marks and format characters lie; ideographs and private use have none.
_BLOCKS = (range(0x3400), range(0xA000, 0xAC00), range(0xF900, 0x20000), range(0x2F800, 0x2FA20), range(0xE0000, 0xE0200))


@lru_cache(maxsize=1)
def level_map() -> dict[int, str]:
    """Code point to the string that stands for it; code points that stay are absent. NFC is not in it."""
    pairs = LOOKALIKES.split()
    lookalike = dict(zip(pairs[::2], pairs[1::2], strict=True))
    out: dict[int, str] = {}
    for code in (c for part in _BLOCKS for c in part):
        ch = chr(code)
        kind = unicodedata.category(ch)
        if kind == "Cn":
            continue
        if kind == "Zs":
            to = " "
        elif kind == "Cf" and unicodedata.bidirectional(ch) not in ("AN", "AL") and unicodedata.name(ch, "").find("NUMBER SIGN") < 0:
            to = ""  # the number signs of Arabic and Kaithi are format characters that can be seen
        else:
            form = unicodedata.decomposition(ch)
            tag, _, rest = form.partition(" ")
            to = ch
            if tag in _SAME_LOOK or (tag == "<compat>" and kind in ("Ll", "Lu", "Lt")):
                to = "".join(chr(int(x, 16)) for x in rest.split())
                to = "".join(out.get(ord(x), x) for x in to) if all(ord(x) < code for x in to) else to
            to = "".join(lookalike.get(x, x) for x in to)
        if to != ch:
            out[code] = to
    out[0x09] = " "
    out[0x2010] = out[0x2011] = "-"
    for code in _INVISIBLE:
        out[code] = ""
    for code in _LINE_BREAKS:
        out[code] = "\n"
    # a mapped character may itself be mapped, as a wide form of a blank is
    return {code: "".join(out.get(ord(x), x) for x in to) for code, to in out.items()}


def fold(text: str) -> str:
    """The consistent form of one string; for whole columns see the vectorised kernels."""
    if text.isascii():
        if "\r" not in text and "\t" not in text and "\x0b" not in text and "\x0c" not in text:
            return text
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    levelled = unicodedata.normalize("NFC", unicodedata.normalize("NFD", text).translate(level_map()))
    return levelled
