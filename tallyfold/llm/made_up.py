"""Passages made up from a corpus's own words, to teach what structure is whatever its layout, and what prose is in any script.

Junk is drawn from a grammar of layouts: records of fields with any separator, lists with any mark, logs, menus, code,
symbols, broken characters, words strung together. Prose is real prose in other dress: wrapped, without punctuation, in
capitals, damaged a little, quoted, or with every letter replaced, as in a language or script that nobody listed.
"""

from __future__ import annotations

import random
import re
import string

#: Sentences of several languages, so that prose is known even where a corpus holds none.
SEED_PROSE = (
    "The boat left before dawn, and nobody on the pier could say when it would be back.",
    "She had asked for a second opinion, but the answer that came was not the one that they had hoped for.",
    "Please close the window if you are the last to leave, because the rain comes in from the west.",
    "Wer früh genug kommt, findet noch einen Platz am Fenster, von dem aus man den ganzen Hafen sieht.",
    "Es war schon dunkel, als wir endlich ankamen, und das Haus war noch nicht geheizt.",
    "Il ne savait pas encore que la lettre était arrivée la veille, et que personne ne l'avait ouverte.",
    "On a souvent dit que cette route était trop étroite pour les camions, mais rien n'a changé depuis.",
    "La casa estaba vacía desde hacía años, pero cada primavera alguien cortaba la hierba del jardín.",
    "No es fácil explicar por qué los vecinos dejaron de hablarse después de la fiesta.",
    "Il treno era già partito quando arrivammo alla stazione, e così decidemmo di andare a piedi fino al lago.",
    "Ninguém sabia ao certo quando a ponte tinha sido construída, mas todos gostavam de passar por ela.",
    "Het water stond zo hoog dat de boeren hun koeien naar de andere kant van de dijk moesten brengen.",
    "Hon hade lovat att skriva så snart hon kom fram, men det dröjde flera veckor innan brevet kom.",
    "Kiedy wróciliśmy do domu, było już późno i nikt nie miał ochoty rozmawiać o tym, co się stało.",
    "Когда поезд наконец пришёл, на платформе уже никого не было, и только ветер носил обрывки газет.",
    "我们到达山顶的时候，太阳已经下山了，但是天空还是红色的，大家都不想马上回去。",
    "彼は何も言わずに部屋を出て行ったので、私たちはどうすればよいのか分からなかった。",
)

_MARKS = ("-", "*", "+", "•", "–", "·", "▪", ">", "»", "#", "~", "=>", "->", "o", "§", "—", "✓", "★", "[ ]", "[x]", "(*)", "|")
_SEPARATORS = ("\t", " | ", "|", ";", "; ", ",", ", ", " / ", "/", " :: ", ":", ": ", " - ", " – ", " & ", "   ", "     ", " = ", "=", " ~ ", "~", " > ", " » ", " .... ", "........", " * ", "^", " -> ", " · ", "\\", " ++ ", "#", "%", " _ ", "__", " • ")
_LEVELS = ("INFO", "WARN", "DEBUG", "ERROR", "TRACE", "notice", "[info]", "[error]", "<warning>", "FATAL", "ok", "fail")
_LINK = ("of", "to", "from", "for", "by", "with", "in", "at", "and", "the", "a", "on", "is", "not", "as", "der", "die", "und", "von", "le", "la", "de", "et", "el", "los", "y", "del")


class Words:
    """Words of prose by kind, from which layouts are filled. Every pick is drawn from ``rng``."""

    def __init__(self, prose: list[str], rng: random.Random):
        found = [w.strip(string.punctuation + "“”«»¿¡…„。，、") for p in prose for w in p.split()]
        self.all = [w for w in found if w] or ["word"]
        self.lower = sorted({w for w in self.all if w.islower() and len(w) > 3}) or ["word"]
        self.capital = sorted({w for w in self.all if w[:1].isupper() and w[1:].islower()}) or ["Word"]
        self.prose, self.rng = prose, rng

    def name(self) -> str:
        r = self.rng
        if r.random() < 0.5:
            return r.choice(self.capital)
        return "".join(r.choice("bcdfgklmnprstv") + r.choice("aeiou") for _ in range(r.randint(1, 4))).capitalize() + r.choice(("n", "t", "s", "r", "", "k"))

    def phrase(self, most: int = 4) -> str:
        return " ".join(self.rng.choice(self.lower) for _ in range(self.rng.randint(1, most)))

    def number(self) -> str:
        r = self.rng
        return r.choice((lambda: str(r.randint(0, 99999)), lambda: f"{r.uniform(0, 100):.{r.randint(1, 3)}f}", lambda: f"{r.randint(0, 100)}%", lambda: f"{r.randint(1, 99)}-{r.randint(1, 99)}", lambda: f"{r.randint(1, 9)},{r.randint(0, 999):03d}"))()

    def code(self) -> str:
        r = self.rng
        made = (
            lambda: "".join(r.choice("0123456789abcdef") for _ in range(r.randint(4, 32))), lambda: "".join(r.choice(string.ascii_letters + string.digits) for _ in range(r.randint(5, 24))),
            lambda: f"{r.choice(string.ascii_uppercase)}{r.randint(1, 999)}", lambda: f"{r.choice(string.ascii_uppercase)}{r.choice(string.ascii_uppercase)}-{r.randint(10, 9999)}-{r.choice(string.ascii_uppercase)}",
            lambda: f"{r.randint(1, 9999)}/{r.randint(1, 99)}-{r.choice(string.ascii_uppercase)}", lambda: "_".join(r.choice(self.lower) for _ in range(2)), lambda: f"0x{r.getrandbits(32):08x}",
            lambda: f"{r.choice(self.lower)}.{r.choice(self.lower)}({r.choice(self.lower)})", lambda: f"{r.randint(1, 255)}.{r.randint(0, 255)}.{r.randint(0, 255)}.{r.randint(0, 255)}", lambda: f"{r.choice(self.lower)}@{r.choice(self.lower)}.net",
        )
        return r.choice(made)()

    def stamp(self) -> str:
        r = self.rng
        a, b = f"{r.randint(1990, 2030)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}", f"{r.randint(0, 23):02d}:{r.randint(0, 59):02d}:{r.randint(0, 59):02d}"
        return r.choice((a, b, f"{a} {b}", f"{a}T{b}Z", f"[{b}]", f"{r.randint(1, 28)}.{r.randint(1, 12)}.", f"{r.randint(1, 12)}/{r.randint(1, 28)}/{r.randint(10, 30)}"))

    def loose(self, n: int) -> list[str]:
        """Words of prose in no order; linking words with them or left out."""
        words = [self.rng.choice(self.all) for _ in range(n)]
        return words if self.rng.random() < 0.6 else [w for w in words if len(w) > 3] or words

    def field(self, kind: int) -> str:
        short = lambda: " ".join(([self.rng.choice(_LINK)] if self.rng.random() < 0.6 else []) + [self.rng.choice(self.lower + _NONE) for _ in range(self.rng.randint(1, 3))])
        return (self.name, self.phrase, self.number, self.code, self.stamp, lambda: self.rng.choice(self.lower), short, lambda: f"{self.rng.choice(self.lower)}={self.number()}", lambda: self.name().upper())[kind]()


_NONE = ["n/a"]


def _records(w: Words) -> list[str]:
    r = w.rng
    kinds, sep = [r.randrange(9) for _ in range(r.randint(2, 7))], r.choice(_SEPARATORS)
    rows = [[w.field(k) if r.random() > 0.05 else "" for k in kinds] for _ in range(r.randint(3, 14))]
    if r.random() < 0.3:  # one width per column
        wide = [max(len(row[i]) for row in rows) + r.randint(1, 4) for i in range(len(kinds))]
        return ["".join(f.ljust(n) for f, n in zip(row, wide, strict=True)) for row in rows]
    if r.random() < 0.15:  # one field per line
        keys = [r.choice(w.lower) for _ in kinds]
        return [f"{k}{r.choice((': ', ' = ', ' '))}{f}" for row in rows[:5] for k, f in zip(keys, row, strict=True)]
    head, tail = r.choice((("", ""), ("", ""), ("", ""), (sep.strip(), sep.strip()), ("", "."), ("", ";"), ("(", ")"), ("", " \\\\"), ("{", "},"), ("<tr><td>", "</td></tr>")))
    sep = "</td><td>" if head == "<tr><td>" else sep
    lines = [head + sep.join(row) + tail for row in rows]
    return lines if r.random() < 0.75 else [r.choice((" ", "; ", " // ", "\t", " | ", ", ")).join(lines)]


def _list(w: Words) -> list[str]:
    r, style = w.rng, w.rng.randrange(5)
    mark = r.choice(_MARKS)
    marks = lambda i: (mark + " ", f"{i + 1}. ", f"{i + 1}) ", f"{string.ascii_lowercase[i % 26]}) ", f"{r.randint(1, 9)}.{r.randint(1, 30)} ")[style]
    shape, indent = r.randrange(8), " " * r.choice((0, 0, 0, 2, 4))

    def item() -> str:
        return (
            lambda: w.phrase(), w.name, lambda: f"{w.name()} {w.number()}", lambda: f"{w.phrase(2)}, {w.phrase(3)}", lambda: f"{r.choice(_LINK)} {w.phrase(2)} {r.choice(_LINK)} {w.name()}",
            lambda: f"{w.name()}: {w.phrase(2)}", lambda: f"{r.choice(w.lower)} {r.choice(w.lower)} {w.name()}", lambda: f"{r.choice(_LINK)} {r.choice(_LINK)} {r.choice(w.lower)}: {r.choice(_LINK)} {r.choice(w.lower)} {r.choice(_LINK)} {w.name()}",
        )[shape]()

    end = r.choice(("", "", "", ";", ".", ","))
    bare = r.random() < 0.25
    return [indent + ("" if bare else marks(i)) + item() + end for i in range(r.randint(3, 16))]


def _inline(w: Words) -> list[str]:
    r, sep = w.rng, w.rng.choice((", ", "; ", " / ", " | ", " » ", " > ", " · ", " - ", ",", " • ", ": ", " + ", " "))
    kinds = r.sample(range(9), r.randint(1, 3))
    pick = [w.field(k) for k in kinds for _ in range(r.randint(1, 6))]
    return [sep.join(r.choice(pick) if r.random() < 0.5 else w.field(r.choice(kinds)) for _ in range(r.randint(8, 70)))]


def _log(w: Words) -> list[str]:
    r = w.rng
    said = [" ".join(w.rng.choice(w.prose).split()[: r.randint(2, 6)]) for _ in range(3)]
    order = r.randrange(4)

    def line() -> str:
        text = r.choice((r.choice(said), w.phrase(3), f"{w.phrase(2)} {r.choice(_LINK)} {r.choice(w.lower)} {r.choice(_LINK)} {w.number()} ms", f"{r.choice(w.lower)} {w.code()} {r.choice(_LINK)} {w.code()}", f"{r.choice(w.lower)}={w.number()} {r.choice(w.lower)}={w.code()}"))
        return (f"{w.stamp()} {r.choice(_LEVELS)} {text}", f"{r.choice(_LEVELS)} {r.choice(w.lower)}: {text} {w.number()}", f"[{w.stamp()}] {w.code()} {text}", f"{r.choice(_LEVELS)} {text} {r.choice(_LINK)} {w.number()} {r.choice(w.lower)}")[order]

    return [line() for _ in range(r.randint(3, 12))]


def _salad(w: Words) -> list[str]:
    """Words strung together: shuffled sentences, keywords, linking words only, no spaces, made-up words."""
    r, kind = w.rng, w.rng.randrange(11)
    n = r.randint(12, 90)
    if kind in (7, 8, 9):  # one sentence after the other, each shuffled
        out = []
        for _ in range(r.randint(1, 6)):
            words = r.choice(w.prose).split()
            r.shuffle(words)
            words = " ".join(x.strip(".,;").lower() for x in words)
            out.append(words[:1].upper() + words[1:] + "." if kind == 7 else words)
        return out if r.random() < 0.6 else [" ".join(out)]
    if kind in (0, 10):
        words = " ".join(r.choice(w.prose) for _ in range(r.randint(1, 3))).split()
        r.shuffle(words)
        words = [x if r.random() < 0.3 else x.strip(".,;") for x in words]
    elif kind == 1:
        words = w.loose(n)
    elif kind == 2:
        words = [r.choice(w.lower) for _ in range(n)]
    elif kind == 3:
        words = [r.choice(_LINK) if r.random() < 0.5 else r.choice(w.lower) for _ in range(n)]
    elif kind == 4:
        words = ["".join(w.loose(r.randint(3, 12))) for _ in range(max(1, n // 8))]
    elif kind == 5:
        letters = r.choice(("bcdfghjklmnpqrstvwxz", string.ascii_lowercase, "aeiou" + string.ascii_lowercase, string.ascii_letters))
        words = ["".join(r.choice(letters) for _ in range(r.randint(1, 18))) for _ in range(n)]
    else:
        few = w.loose(r.randint(1, 6))
        words = [r.choice(few) for _ in range(n)]
    step = r.choice((1, 1, 4, 8, n, n, n))
    cut = [" ".join(words[i : i + step]) for i in range(0, len(words), step)]
    end = r.choice(("", "", ".", "!"))
    return [(c[:1].upper() + c[1:] if r.random() < 0.5 else c) + end for c in cut]


def _symbols(w: Words) -> list[str]:
    r, kind = w.rng, w.rng.randrange(5)
    if kind == 0:
        chars = r.choice(("!@#$%^&*()_+-=[]{};':|,.<>/?~", "█▒░■□▲▼◆●○", "01", "-=_*~", "{}[]();,.:", "абвгдежзик;:!№%", "ÃÂâ€™�ï¿½©±aeiourn "))
        return ["".join(r.choice(chars + "  ") for _ in range(r.randint(30, 160))) for _ in range(r.randint(1, 5))]
    if kind == 1:
        return ["".join(r.choice(string.ascii_letters + string.digits + "+/") for _ in range(r.randint(40, 200))) for _ in range(r.randint(1, 5))]
    if kind == 2:  # prose damaged beyond reading
        noise = r.choice(("~^|;:'.1l", "�Ã©Â", "#@%&", string.ascii_lowercase + "  ", string.punctuation))
        return ["".join(c if r.random() < 0.45 else r.choice(noise) for c in r.choice(w.prose)) for _ in range(r.randint(1, 4))]
    if kind == 3:
        line = r.choice((w.phrase(2), w.name(), w.number(), r.choice(w.prose)[:30]))
        return [line] * r.randint(4, 12) if r.random() < 0.5 else [(line + r.choice((" ", ", ", ""))) * r.randint(5, 30)]
    mixed = list(" ".join(r.choice(w.prose) for _ in range(2)))
    r.shuffle(mixed)
    return ["".join(mixed)]


def _source(w: Words) -> list[str]:
    r, a = w.rng, lambda: w.rng.choice(w.lower)
    made = (
        lambda: f"{' ' * r.choice((0, 2, 4))}{a()} = {a()}.{a()}({a()}, {w.number()});", lambda: f"if ({a()} > {w.number()}) {{ return {a()}; }}", lambda: f'"{a()}": "{w.phrase(2)}",', lambda: f"<{a()} {a()}=\"{w.code()}\">{w.name()}</{a()}>",
        lambda: f"SELECT {a()}, {a()} FROM {a()}_{a()} WHERE {a()} = {w.number()};", lambda: f"https://{a()}.net/{a()}/{w.code()}?{a()}={w.number()}", lambda: f"at {a()}.{a()}({a()}.py:{r.randint(1, 900)})", lambda: f"{a()}: [{w.number()}, {w.number()}, {w.number()}]",
        lambda: f'{{"{a()}_{r.randint(1, 99)}":{{"{a()[0]}":{r.randint(0, 99)},"v":[{r.randint(0, 9)},{r.randint(0, 9)}]}}}},', lambda: f"$ {a()} --{a()} {w.code()}", lambda: f"def {a()}_{a()}({a()}):", lambda: f"#{a()} #{a()} #{a()}",
    )
    used = r.sample(made, r.randint(1, 3))
    lines = [r.choice(used)() for _ in range(r.randint(3, 12))]
    return lines if r.random() < 0.8 else ["".join(lines)]


def _outline(w: Words) -> list[str]:
    r, out = w.rng, []
    dots = r.choice((" ........ ", " . . . . ", "\t", "  ", " — ", " -- ", "………", " [", " p. "))
    for _ in range(r.randint(2, 5)):
        out.append(r.choice((w.name().upper(), w.phrase(3).capitalize(), f"{r.randint(1, 9)} {w.phrase(2)}")))
        out += [f"{' ' * r.choice((0, 3))}{r.choice(('', '- ', f'{r.randint(1, 9)}.{r.randint(1, 9)} '))}{r.choice((w.phrase(3), w.name()))}{dots}{r.choice((w.number(), w.phrase(1)))}" for _ in range(r.randint(2, 5))]
    return out


JUNK = (_records, _records, _list, _list, _inline, _log, _salad, _salad, _salad, _symbols, _source, _outline)


def _ciphered(text: str, key: int, script: str) -> str:
    """``text`` with its letters replaced one by one, vowels by vowels, as in an unknown language; or in another script."""
    r = random.Random(key)
    if script == "latin":
        table = {}
        for group in ("aeiouy", "bcdfghjklmnpqrstvwxz"):
            to = list(group)
            r.shuffle(to)
            table |= dict(zip(group, to, strict=True)) | dict(zip(group.upper(), "".join(to).upper(), strict=True))
        return text.translate(str.maketrans(table))
    if script in ("greek", "cyrillic", "plain"):
        # the last is a script without capitals
        first, n = {"greek": (0x03B1, 17), "cyrillic": (0x0430, 32), "plain": (0x05D0, 26)}[script]
        to = [chr(first + i % n) for i in range(26)]
        r.shuffle(to)
        table = dict(zip(string.ascii_lowercase, to, strict=True)) | dict(zip(string.ascii_uppercase, [c.upper() for c in to], strict=True))
        return text.translate(str.maketrans(table))
    # a script without spaces: every word becomes one to three characters
    out = []
    for word in text.split():
        core = word.strip(string.punctuation)
        local = random.Random(f"{key}{core.lower()}")
        made = "".join(chr(0x4E00 + local.randrange(4000)) for _ in range(1 + min(2, len(core) // 4))) if not core.isdigit() else core
        out.append(made + {".": "。", ",": "，", "?": "？", "!": "！"}.get(word[-1:], ""))
    return "".join(out)


def _dressed(prose: list[str], rng: random.Random) -> list[str]:
    """Prose in other dress, one passage per line."""
    kind = rng.randrange(14)
    if kind == 0:
        return prose
    if kind == 1:  # wrapped
        words, out, line = " ".join(prose).split(), [], ""
        width = rng.randint(35, 90)
        for word in words:
            if len(line) + len(word) > width:
                out.append(line)
                line = ""
            line = f"{line} {word}".strip()
        return [*out, line]
    if kind == 2:
        return [p.lower().translate(str.maketrans("", "", ".,;:!?¿¡")) for p in prose]
    if kind == 3:
        return [p.upper() for p in prose]
    if kind == 4:
        return [p.rstrip(".!?") for p in prose]
    if kind == 5:  # read wrongly in places
        return ["".join(c if rng.random() > 0.05 else rng.choice("~^|.'1lrnec ") for c in p) for p in prose]
    if kind == 6:
        return [f"{rng.choice(('Q', 'A', 'Note', 'Re'))}: {p}" if rng.random() < 0.7 else f"> {p}" for p in prose]
    if kind == 7:
        return [p.encode("utf-8").decode("cp1252", "replace") for p in prose]
    if kind == 12:  # notes: a clause, or a few words of one, without the words that link
        clauses = [c.strip().split() for p in prose for c in re.split(r"[.,;:!?]", p)]
        return [" ".join(w for i, w in enumerate(c[: rng.randint(4, 9)]) if i == 0 or len(w) > 2 or rng.random() < 0.7).lower() for c in clauses if len(c) >= 4]
    if kind == 13:  # full of figures
        figure = lambda: rng.choice((f"{rng.randint(2, 9999)}", f"{rng.uniform(0, 99):.1f}", f"{rng.randint(1, 99)} %", f"({rng.uniform(0, 30):+.1f} %)", f"(n = {rng.randint(3, 900)})", f"{rng.randint(1, 99)} of {rng.randint(99, 999)}"))
        return [" ".join(f"{w} {figure()}" if rng.random() < 0.25 else w for w in p.split()) for p in prose]
    if kind == 8:  # run together without stops
        return [" ".join(p.rstrip(".") for p in prose)]
    return [_ciphered(p, rng.randrange(50), rng.choice(("latin", "latin", "greek", "cyrillic", "plain", "unspaced", "unspaced"))) for p in prose]


def made_up(prose: list[str], documents: int, seed: int) -> list[tuple[list[str], list[int]]]:
    """Documents as ``(lines, label of each line)``, 1 for junk: blocks of prose in one dress and blocks of one layout."""
    rng = random.Random(seed)
    prose = [p for p in prose if len(p.split()) >= 4 or len(p) >= 25] + list(SEED_PROSE)
    spaced = [p for p in prose if len(p.split()) >= 4]
    words, out = Words(spaced, rng), []
    for _ in range(documents):
        lines, labels = [], []
        for _ in range(rng.randint(1, 3)):
            if rng.random() < 0.45:
                block = _dressed([rng.choice(prose if rng.random() < 0.8 else SEED_PROSE) for _ in range(rng.randint(1, 7))], rng)
                block, label = [b for b in block if b.strip()], 0
            else:
                block, label = [b for b in rng.choice(JUNK)(words) if b.strip()], 1
                if rng.random() < 0.15:
                    script = rng.choice(("latin", "cyrillic", "greek"))
                    key = rng.randrange(50)
                    block = [_ciphered(b, key, script) for b in block]
            lines += block
            labels += [label] * len(block)
        out.append((lines, labels))
    return out
