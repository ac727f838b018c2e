"""Labelled findings to train the secret scan on: fixed kinds of true and false ones, by a seeded draw.

Each is a line of text, the place of the candidate in it, and whether it is a secret. Harmless words
are drawn from the words given, for example those of a corpus. Digits alone are a secret only as the
value of a password; a short value is one only after a secret name.
"""

from __future__ import annotations

import base64
import random
import string
from collections.abc import Sequence

# Names that stand before secrets and before harmless strings, and forms of known keys.
SECRET_NAMES = (
    "token", "api_key", "apikey", "secret", "password", "passwd", "access_key", "auth_token", "client_secret", "private_key", "key", "bearer",
)
HARMLESS_NAMES = (
    "commit", "sha1", "md5", "checksum", "etag", "id", "uuid", "version", "file", "path", "url", "href", "class", "digest",
    "order", "invoice", "account", "card", "phone", "tracking", "number", "data", "image", "content",
)
PASSWORD_NAMES = ("password", "passwd", "secret")
SHORT_PLACEHOLDERS = ("changeme", "password", "required", "<hidden>", "********", "undefined", "redacted", "os.environ", "example1")
LEET = {"a": "4@", "e": "3", "i": "1!", "o": "0", "s": "5$"}
ENDINGS = ("com", "org", "net", "de", "fr", "es")
SIGNS = "!@#$%&*-_"
PREFIXES = ("ghp_", "AKIA", "sk_live_", "xoxb-", "glpat-", "AIza", "npm_", "")
PLACEHOLDERS = ("your_api_key_goes_here", "REPLACE_WITH_YOUR_TOKEN", "example-token-example", "xxxxxxxxxxxxxxxxxxxxxxxx", "changeme-changeme-changeme")
WORDS = (
    "the that with this from have they which about would there their people into time other could first water after value "
    "address client config default element error event example field file filter format function handler header index input "
    "item length list local message method model module name number object option output parameter password path process "
    "property query record request response result return schema server service session source status string system table "
    "target test text title token type update user version"
).split()
_HEX, _ALNUM = "0123456789abcdef", string.ascii_letters + string.digits
_SYLLABLES = "the an er on in re at nd st ha en ou ea ti es or it ar te ion de que le ung ver ein aus ado mente".split()


def _drawn(draw: random.Random, letters: str, n: int) -> str:
    return "".join(draw.choice(letters) for _ in range(n))


def _word(draw: random.Random) -> str:
    word = "".join(draw.choice(_SYLLABLES) for _ in range(draw.randint(5, 12)))
    return draw.choice((word, word.upper(), word.capitalize()))


def _secret(draw: random.Random) -> str:
    prefix = draw.choice(PREFIXES)
    body = draw.choice(
        (
            _drawn(draw, _HEX, draw.choice((32, 40, 40, 64))), _drawn(draw, _ALNUM, draw.randint(20, 48)),
            _drawn(draw, _HEX.upper(), draw.choice((32, 40))), base64.b64encode(draw.randbytes(draw.randint(18, 40))).decode(),
        )
    )
    return (prefix + body) if draw.random() < 0.4 else body


def _short_secret(draw: random.Random, words: Sequence[str]) -> str:
    """A password of 8 to 15 characters, or of digits alone."""
    kind = draw.randrange(4)
    if kind == 0:
        return _drawn(draw, string.digits, draw.randint(8, 19))
    if kind == 1:
        word = "".join(draw.choice(LEET[c]) if c in LEET and draw.random() < 0.7 else c for c in draw.choice(words))
        word = word[:12].capitalize() if draw.random() < 0.5 else word[:12]
        return word + _drawn(draw, string.digits, max(2, 7 - len(word))) + draw.choice(SIGNS)
    return _drawn(draw, _ALNUM + (SIGNS if kind == 2 else ""), draw.randint(8, 15))


def _harmless(draw: random.Random, words: Sequence[str]) -> tuple[str, bool]:
    """A string, and whether a harmless name must stand before it."""
    kind = draw.randrange(11)
    if kind == 0:
        return _word(draw), False
    if kind == 1:
        return "/".join(draw.choice(words) for _ in range(draw.randint(3, 6))) + draw.choice((".py", ".html", "/index", "")), False
    if kind == 2:
        return draw.choice(PLACEHOLDERS), False
    if kind == 3:
        return "_".join(draw.choice(words) for _ in range(draw.randint(3, 6))), False
    if kind == 4:
        h = _drawn(draw, _HEX, 32)
        return f"{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}", True
    if kind == 5:
        made = draw.choice(words)
        while len(made) < 16:
            made += draw.choice(words)
        return draw.choice((made, made.upper(), made.capitalize())), False
    if kind == 6:
        host = ".".join(draw.choice(words) + draw.choice(("", str(draw.randrange(100)))) for _ in range(draw.randint(2, 3)))
        return f"{host}.{draw.choice(ENDINGS)}", False
    if kind == 7:
        text = " ".join(draw.choice(words) for _ in range(draw.randint(3, 6)))
        return base64.b64encode(text.encode()).decode(), True
    if kind in (8, 9):
        digits = _drawn(draw, string.digits, draw.randint(16, 19))
        return (digits if kind == 8 else "-".join(digits[k : k + 4] for k in range(0, 16, 4))), draw.random() < 0.5
    return _drawn(draw, _HEX, draw.choice((32, 40, 64))), True


def _short_harmless(draw: random.Random, words: Sequence[str]) -> str:
    """What stands after a secret name and is none: a word, a call, a path or a placeholder."""
    kind = draw.randrange(4)
    if kind == 0:
        return draw.choice(SHORT_PLACEHOLDERS)
    word = draw.choice(words)
    while len(word) < 8 or kind > 1:
        word += ("", "", "_", ".")[kind] + draw.choice(words)
        kind = min(kind, 1)
    return draw.choice((word, word.capitalize(), word.upper()))


def labelled_findings(n: int = 4000, seed: int = 10, words: Sequence[str] = WORDS) -> list[tuple[str, int, int, int]]:
    """``n`` findings: line, start and end of the candidate, and 1 for a secret; the same for the same seed and words."""
    draw = random.Random(seed)
    out = []
    for _ in range(n):
        before, after = (" ".join(draw.choice((_word(draw)[:9], draw.choice(words))) for _ in range(draw.randint(0, 4))) for _ in range(2))
        label, short = int(draw.random() < 0.5), draw.random() < 0.25
        signs = (" = ", "=", ": ", ":")
        if short:
            text = _short_secret(draw, words) if label else _short_harmless(draw, words)
            name, strong = draw.choice(PASSWORD_NAMES if text.isdigit() else SECRET_NAMES), True
        elif label:
            text = _secret(draw)
            name, strong = draw.choice(SECRET_NAMES) if draw.random() < 0.9 else "", True
            signs = (*signs, " ")
        else:
            text, named = _harmless(draw, words)
            strong = named or draw.random() < 0.3
            allowed = HARMLESS_NAMES if named or text[0].isdigit() or draw.random() < 0.6 else (*HARMLESS_NAMES, *SECRET_NAMES)
            name = draw.choice(allowed) if strong else ""
            signs = (*signs, " ")
        name = draw.choice((name, name.upper(), name.capitalize())) if name else ""
        sign = draw.choice(signs) if name else " "
        quote = draw.choice(('"', "'", "")) if strong else ""
        head = f"{before} {name}{sign}{quote}"
        out.append((f"{head}{text}{quote} {after}", len(head), len(head) + len(text), label))
    return out
