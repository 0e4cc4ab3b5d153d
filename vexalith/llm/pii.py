"""Problem 8: personal information in free text: found, and replaced by typed placeholders.

Regular expressions propose spans with a score for their shape; checksums (Luhn, mod 97, the
letter of an eight-digit identity number) and words in the 48 characters before the span raise or
lower it; spans of at least ``ACCEPT`` stay. Where spans overlap, the kind that comes first in
``KINDS`` wins. Matching looks at a *view* of the text in which entities, tags and wrongly decoded
letters are undone, and maps every span back to the text as it stands.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, table

KINDS = ("email", "phone", "id_number", "address", "person")
ACCEPT = 1.0
BEFORE = 48

# ---- Fixed values: words that stand before numbers, parts of addresses, names. ----
PHONE_WORDS = "call|dial|phone|tel|telephone|mobile|cell|fax|number is|ring me|reach me|text me|llám|llam|teléf|telef|móvil|número|numero|anruf|ruf|nummer|handy|telefon|appel|téléph|numéro|телефон|звони|номер|тел"
ID_WORDS = "passport|social security|ssn|id|identity|identification|national|license|licence|card with|insurance|pasaporte|dni|nie|documento|identidad|ausweis|ausweisnummer|pass|personalausweis|reisepass|passeport|carte d'identité|identité|паспорт|документ|документа|снилс|инн"
OTHER_NUMBER_WORDS = "order|case|serial number|serial|flight|room|episode|code|invoice|version|part|track|page|chapter|pedido|vuelo|habitación|caso|código|bestellung|zimmer|flug|fall|commande|vol|chambre|affaire|заказ|рейс|комната|код"
DIGIT_WORDS = {
    "en": "zero|oh|one|two|three|four|five|six|seven|eight|nine",
    "es": "cero|uno|dos|tres|cuatro|cinco|seis|siete|ocho|nueve",
    "de": "null|eins|zwei|zwo|drei|vier|fünf|sechs|sieben|acht|neun",
    "fr": "zéro|un|deux|trois|quatre|cinq|six|sept|huit|neuf",
    "ru": "ноль|один|два|три|четыре|пять|шесть|семь|восемь|девять",
}
STREETS_AFTER = "Street St Avenue Ave Road Rd Lane Ln Way Court Ct Drive Dr Boulevard Blvd Terrace Place Pl Square Sq Row Close Crescent Parkway Pkwy Circle Alley Trail Highway Hwy Walk Mews"
SIDES = "North South East West Northeast Northwest Southeast Southwest Old New Upper Lower Great Little"
UNITS = "Apt Apartment Unit Suite Ste Flat Floor Room Rm"
STREETS_ES = "C/|Calle|Avenida|Avda\\.?|Av\\.|Plaza|Paseo|Camino|Carrera|Ronda|Travesía|Carretera"
STREETS_DE = "straße|strasse|str\\.|weg|gasse|allee|platz|ring|damm|ufer|steig|stieg|chaussee|promenade"
STREETS_FR = "rue|avenue|av\\.|boulevard|bd\\.?|chemin|place|impasse|quai|allée|cours|route|passage|ruelle|square|sentier"
STREETS_RU = "ул\\.|улица|улице|пр\\.|пр-т|проспект|проспекте|пер\\.|переулок|переулке|пл\\.|площадь|бульвар|шоссе|наб\\.|набережная"
TOP_DOMAINS = "com org net edu gov info biz io co test example invalid localhost de es fr ru uk us eu ch at it nl be pl ca au"
TITLES = "Mr Mrs Ms Miss Dr Prof Sir Madam Sr Sra Srta Don Doña Herr Frau Hr Fr Mme Mlle M Monsieur Madame Г-н Г-жа Господин Госпожа"
CREDITS = "translation|translated by|subtitles|subtitles by|subtitled by|captions by|edited by|synced by|corrections by|traducción|subtítulos|traducido por|untertitel|übersetzung|traduction|sous-titres|adaptation|перевод|субтитры|редактор"
INTRODUCTIONS = "my name is|name's|me llamo|mi nombre es|ich heiße|mein name ist|je m'appelle|mon nom est|меня зовут|моё имя"
#: Words before which a name of two words stands, whatever the names are.
NAME_CONTEXTS = "know knows knew met meet ask asked tell told called named i'm am married dear conoce conoces conozco conocí llama llamo soy pregunta dile connais connaissez appelle m'appelle suis rencontré kenne kennst kennt kannte heiße heißt bin frag знаю знаешь знаете знает зовут зовите видел встретил спроси"
#: Words that begin the names of places and works, not of persons.
PLACE_STARTS = "New Old Big Great Little North South East West Upper Lower Central Grand Royal Los Las San Santa Saint St Mount Port Lake Nueva Nuevo Saint-Denis Notre United White Red Black Golden Black Holy"
PARTICLES = "von van de der den del della di da dos la le du ten ter zu af al bin"
PLACES = "Heights Falls Square Bay Street Road Lane Avenue Park Beach Hill Hills Lake River Island Islands Valley City Town County Bridge Station Airport Harbor Harbour Point Springs Creek Mountain Forest Gardens Castle Church School College University Hospital Hotel House Tower Building Center Centre Plaza Market Village Port Cape Mount"
GIVEN_EN = "Adam Alan Albert Alex Alexander Alfred Alice Amanda Amy Andrea Andrew Angela Ann Anna Anne Anthony Arthur Barbara Ben Benjamin Betty Bill Brian Carl Caroline Catherine Charles Charlotte Chris Christine Christopher Claire Clara Daniel David Deborah Dennis Diana Donald Dorothy Edith Edward Eleanor Elizabeth Emily Emma Eric Ethan Eva Evelyn Felix Florence Frances Frank Fred George Grace Hannah Harold Harry Helen Henry Hugo Ian Irene Isaac Jack Jacob James Jane Jason Jennifer Jessica Joan John Jonathan Joseph Joshua Judith Julia Julie Karen Kate Kenneth Kevin Laura Lauren Leo Lewis Linda Lisa Louis Lucy Margaret Maria Marie Mark Martha Martin Mary Matthew Max Megan Michael Nancy Nathan Nicholas Nicole Nina Noah Nora Oliver Olivia Oscar Patricia Patrick Paul Peter Philip Rachel Ralph Rebecca Richard Robert Roger Ronald Rose Ruth Ryan Samuel Sandra Sarah Scott Sharon Simon Sophia Stephen Steven Susan Theodore Thomas Timothy Victor Victoria Vincent Virginia Walter William"
GIVEN_ES = "Alberto Alejandro Álvaro Ana Andrés Antonio Beatriz Belén Carlos Carmen Cristina Diego Eduardo Elena Enrique Esteban Eva Fernando Francisco Gonzalo Ignacio Inés Isabel Iván Javier Jesús Joaquín Jorge José Juan Julio Laura Lucía Luis Manuel Marcos María Mario Marta Mercedes Miguel Nuria Óscar Pablo Paula Pedro Pilar Rafael Ramón Raúl Ricardo Roberto Rocío Rosa Rubén Sara Sergio Silvia Sofía Teresa Tomás Víctor"
GIVEN_DE = "Andreas Anja Anke Barbara Bernd Birgit Björn Brigitte Christa Christian Claudia Dieter Dirk Elke Erika Ernst Frank Franz Friedrich Fritz Gerhard Gisela Götz Günter Hans Heike Heinrich Heinz Helga Helmut Herbert Hermann Horst Ingrid Jan Jens Jörg Jürgen Karin Karl Käthe Katrin Klaus Kurt Lukas Manfred Markus Martina Matthias Michael Monika Nadine Otto Petra Rainer Ralf Renate Rolf Sabine Silke Stefan Susanne Thorsten Ulrich Ursula Ute Uwe Volker Werner Wilhelm Wolfgang"
GIVEN_FR = "Alain André Antoine Aurélie Bernard Brigitte Camille Catherine Cécile Céline Chloé Christophe Claude Denis Didier Dominique Élise Élodie Émile Éric Étienne Fabrice François Françoise Frédéric Gérard Guillaume Hélène Henri Isabelle Jacques Jean Jérôme Julien Laurent Léa Louis Luc Lucie Madeleine Marc Margaux Marguerite Marie Mathieu Michel Monique Nathalie Nicolas Noël Zoé Benoît Gilles Manon Mathilde Florence Aline Odile Olivier Pascal Paul Philippe Pierre René Robert Sébastien Simone Sophie Stéphane Sylvie Théo Thérèse Thierry Valérie Véronique Yves"
GIVEN_RU = "Александр Алексей Алёна Анастасия Андрей Анна Антон Борис Вадим Валентина Вера Виктор Виталий Владимир Галина Георгий Глеб Григорий Дарья Денис Дмитрий Евгений Екатерина Елена Зоя Иван Игорь Илья Инна Ирина Кирилл Константин Ксения Лариса Лев Лидия Людмила Максим Маргарита Марина Мария Михаил Надежда Наталья Никита Николай Нина Олег Ольга Павел Пётр Полина Роман Светлана Семён Сергей Софья Тамара Татьяна Фёдор Юлия Юрий Яков"
#: Words that are no family name though written with a capital.
COMMON = "i the a an and or but if is was were are it its he she we you they this that there here what who where when why how my your his her our their not no yes of in on at by to for from with without all any some come have has had do does did don't will would can could should may might must very well just now then so as too also never always please thank thanks hello hi goodbye good listen look wait stop let's let sie er es wir ich du ist war hat haben und oder aber nicht ein eine der die das den dem mit von zu auf für wo was wer wie warum natürlich bitte danke yo tú él ella es está fue no sí el la los las un una que qué quién dónde cuándo cómo por para con sin mi su muy bien gracias je tu il elle nous vous ils est était le la les un une des et ou mais pas ne que qui où quand comment pourquoi avec sans mon ton son bien merci я ты он она мы вы они это не да нет и или но что кто где когда как почему с без мой твой ready left wants said says told went called ask asked come hey okay oh warte wart komm hör sieh schau los hallo guten nein attends viens regarde écoute bonjour salut espera mira oye ven escucha hola sorry sure right fine yeah maybe perhaps really quick hurry careful cuidado vorsicht attention осторожно подожди слушай смотри иди привет"

_SP = r"(?:[ \t]+(?:\r\n|[\r\n])?[ \t]*|(?:\r\n|[\r\n])[ \t]*)"
_OPT = r"[ \t]*(?:\r\n|[\r\n])?[ \t]*"


def _both(words: str) -> str:
    """The words of a list as they are and in capitals, as alternatives, longest first."""
    w = words.split()
    return "|".join(sorted({re.escape(x) for v in w for x in (v, v.upper())}, key=lambda x: (-len(x), x)))


class _Folds(dict):
    """Word -> folded word, for the words met lately."""

    def __missing__(self, word: str) -> str:
        if len(self) > 200_000:
            self.clear()
        out = self[word] = _folded_word(word)
        return out


_FOLDS = _Folds()


def _fold(word: str) -> str:
    """Letters that text recognition confuses, accents and case made equal."""
    return _FOLDS[word]


def _folded_word(word: str) -> str:
    w = unicodedata.normalize("NFD", word.lower())
    w = "".join(c for c in w if c == "\u0303" or not unicodedata.combining(c)).replace("rn", "m").replace("vv", "w")
    return w.translate(_SAME)


def _folded(words: str) -> str:
    return "|".join(_fold(w) for w in words.split("|"))


_SAME = str.maketrans({"l": "i", "1": "i", "|": "i", "0": "o", "5": "s", "8": "b", "c": "e", "f": "t", "q": "g", "h": "b", "ё": "е"})
GIVEN = frozenset(_fold(w) for w in " ".join((GIVEN_EN, GIVEN_ES, GIVEN_DE, GIVEN_FR, GIVEN_RU)).split())
_COMMON = frozenset(COMMON.split())
_PLACE_STARTS = frozenset(PLACE_STARTS.split())
_PLACES = frozenset(_fold(w) for w in PLACES.split())
_TITLES = frozenset(w.lower() for w in TITLES.split())
_PARTICLES = frozenset(PARTICLES.split())
_TOP = frozenset(TOP_DOMAINS.split())

# ---- The view ----
_LATER = "[\x80-\xbf€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]"
_UTF8 = re.compile(f"(?:[ÂÃÐÑ]{_LATER}|â{_LATER}{_LATER})+")
_UNDO = re.compile(r"&(?:#\d{1,6}|#x[0-9a-fA-F]{1,6}|[a-zA-Z]{2,8});|<[/a-zA-Z][^<>\r\n]{0,60}>|\{[\\/a-zA-Z][^{}\r\n]{0,40}\}")
_LATIN_UP = re.compile("[À-ÿ][À-ÿ]+")
_CYRILLIC = {c: bytes([c]).decode("cp1251") for c in range(0xC0, 0x100)} | {0xA8: "Ё", 0xB8: "ё"}


def _cp1252(text: str) -> bytes | None:
    out = bytearray()
    for c in text:
        if ord(c) < 256:
            out.append(ord(c))
        else:
            try:
                out += c.encode("cp1252")
            except UnicodeEncodeError:
                return None
    return bytes(out)


def _readable(piece: str) -> str | None:
    raw = _cp1252(piece)
    if raw is None:
        return None
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return None


def view_of(text: str) -> tuple[str, tuple[list[int], list[int]] | None]:
    """(the text to match on; for each of its characters where in text it starts and ends)."""
    at = None
    if "Ð" in text or "Ã" in text or "Â" in text:
        text, at = _rewritten(text, at, _UTF8, _readable)
        if "Ð" in text or "Ã" in text:
            text, at = _rewritten(text, at, _UTF8, _readable)
    if "&" in text or "<" in text or "{" in text:
        text, at = _rewritten(text, at, _UNDO, lambda x: html.unescape(x) if x[0] == "&" else "")
    if len(_LATIN_UP.findall(text)) * 24 > len(text) // 8:
        text = text.translate(_CYRILLIC)
    return text, at


def _rewritten(text: str, at: tuple[list[int], list[int]] | None, pattern: re.Pattern, change) -> tuple[str, tuple[list[int], list[int]] | None]:
    out: list[str] = []
    start: list[int] = []
    end: list[int] = []
    last = 0
    for m in pattern.finditer(text):
        new = change(m.group())
        if new is None:
            continue
        out += (text[last : m.start()], new)
        start += range(last, m.start())
        end += range(last + 1, m.start() + 1)
        start += [m.start()] * len(new)
        end += [m.end()] * len(new)
        last = m.end()
    if not out:
        return text, at
    out.append(text[last:])
    start += range(last, len(text))
    end += range(last + 1, len(text) + 1)
    if at is not None:
        start, end = [at[0][i] for i in start], [at[1][i - 1] for i in end]
    return "".join(out), (start, end)


# ---- Mail addresses ----
_MAIL = re.compile(r"[\w+-]+(?:\.[\w+-]+)*" + rf"(?:@{_OPT}|{_SP}@{_SP})" + r"[\w-]+(?:\.[\w-]+)*")
_MAIL_TAIL = re.compile(rf"\.{_OPT}([\w-]+)")
_MARK = rf"{_OPT}[\[({{<]{_OPT}(?:at|arroba|ät){_OPT}[\])}}>]{_OPT}"
_DOT = rf"(?:{_OPT}[\[({{<]{_OPT}(?:dot|punto|point|punkt){_OPT}[\])}}>]{_OPT}|{_SP}(?:dot|punto|punkt){_SP})"
_LOCAL = r"[\w+-]+(?:\.[\w+-]+)*"
_SPELT = (
    re.compile(rf"{_LOCAL}{_MARK}[\w-]+(?:(?:{_DOT}|\.)[\w-]+)+", re.I),
    re.compile(rf"{_LOCAL}{_SP}(?:at|arroba|@){_SP}[\w-]+(?:{_DOT}[\w-]+)+", re.I),
)
_SPELT_WORDS = ("dot", "punto", "punkt")
_SPELT_WORD = re.compile(r"\b(?:dot|punto|punkt)\b")
_SPELT_BRACKET = re.compile(rf"[\[({{<]{_OPT}(?:at|arroba|ät|dot|punto|point|punkt){_OPT}[\])}}>]")


def _local_start(v: str, at: int) -> int:
    """Where the run of characters that a local part can consist of, before the sign at ``at``, begins."""
    i = at
    while i > 0 and v[i - 1] in " \t\r\n":
        i -= 1
    while i > 0 and (v[i - 1].isalnum() or v[i - 1] in "_+.-"):
        i -= 1
    return i


def _mails(v: str, low: str) -> Iterator[tuple[int, int]]:
    at = v.find("@")
    while at >= 0:
        here, at = at, v.find("@", at + 1)
        m = _MAIL.search(v, _local_start(v, here), len(v) if at < 0 else at)
        if not m or not m.start() < here < m.end():
            continue
        domain = v[m.start() : m.end()].rpartition("@")[2].strip()
        end = m.end()
        if domain.rpartition(".")[2].lower() not in _TOP and "@" in m.group().split()[0]:
            next_ = end
            for _ in range(3):
                tail = _MAIL_TAIL.match(v, next_)
                if not tail:
                    break
                next_ = tail.end()
                if tail.group(1).lower() in _TOP:
                    end = next_
                    break
        if "." not in domain and end == m.end():
            continue
        yield m.start(), end
    if (any(x in low for x in _SPELT_WORDS) and _SPELT_WORD.search(low)) or _SPELT_BRACKET.search(low):
        for pattern in _SPELT:
            for m in pattern.finditer(v):
                yield m.start(), m.end()


# ---- Numbers ----
#: Where a pattern begins with a set of characters, only these are tried: what must not stand before is looked at after the first.
_D = "[0-9OolI]"
_RUN = re.compile(rf"[(+0-9lIO](?<![\w.,:#&/+-][(+0-9lIO])(?:(?<=\()\+?[0-9lIO]|(?<=\+)[0-9lIO]|(?<=[0-9lIO]))[0-9OolI ()./\r\n-]{{4,24}}[0-9OolI](?:-?[A-Z](?![A-Za-z]))?(?![\w:])")
_PART = re.compile(r"[\s./-]+")
_OCR = str.maketrans({"O": "0", "o": "0", "l": "1", "I": "1"})
_PHONE_BEFORE = re.compile(rf"(?<!\w)(?:{_folded(PHONE_WORDS)})")
_ID_BEFORE = re.compile(rf"(?<!\w)(?:{_folded(ID_WORDS)})(?!\w)")
_OTHER_BEFORE = re.compile(rf"(?<!\w)(?:{_folded(OTHER_NUMBER_WORDS)})(?!\w)")
_CODED = re.compile(r"[A-Z](?<![\w-][A-Z])[A-Z]?[ -]?\d[\dA-Z]")
_LETTERED = re.compile(r"[A-Z]{1,2}[ -]?\d{6,9}(?:-?[A-Z])?(?![\w-])")
_IBAN = re.compile(r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
_SHAPES = (
    # kind, shape of the digits (9), score
    ("id_number", re.compile(r"999[- ]99[- ]9999"), 1.0),
    ("id_number", re.compile(r"999999-9999"), 0.6),
    ("id_number", re.compile(r"99999999-?[A-Z]"), 0.6),
    ("phone", re.compile(r"\(?\+9{1,3}\)?[ .-]?(?:\(?9{1,5}\)?[ ./-]?){1,6}9"), 1.2),
    ("phone", re.compile(r"(?:9[ .-])?\(?999\)?[ .-]999[ .-]9999"), 1.2),
    ("phone", re.compile(r"(?:8|9)[ -]\(?999\)?[ -]999[ -]99[ -]99"), 1.2),
    ("phone", re.compile(r"09(?:[ .]99){4}"), 1.2),
    ("phone", re.compile(r"0999?9?[ /-]9{3,8}(?:[ -]9{1,5})?"), 1.1),
    ("phone", re.compile(r"09[ /-]9{3,8}(?:[ -]9{1,5})?"), 1.1),
    ("phone", re.compile(r"999-9999"), 1.0),
    ("phone", re.compile(r"999[ -]999[ -]999|999 99 99 99|9{9,10}"), 0.4),
)
_WORDED = re.compile("|".join(rf"(?<!\w)(?:{w})(?:[-, ]{{1,2}}(?:\r?\n)?(?:{w})){{6,14}}(?!\w)" for w in DIGIT_WORDS.values()), re.I)
_DIGIT_WORDS = frozenset(x for w in DIGIT_WORDS.values() for x in w.split("|"))


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    s = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in s)) % 97 == 1


def identity_letter(number: str) -> bool:
    """The letter of an eight-digit identity number: its remainder by 23 in a fixed order."""
    return number[-1] == "TRWAGMYFPDXBNJZSQVHLCKE"[int(number[:8]) % 23]


def _context(v: str, start: int, kind: str) -> float:
    """What the words before a number add to its score."""
    before = v[max(0, start - BEFORE) : start]
    cut = max(before.rfind("\n\n"), before.rfind("\r\n\r\n"), before.rfind(". "), before.rfind("! "), before.rfind("? "))
    # An abbreviation's dot ("Tel. 555") does not end the sentence.
    if cut >= 0 and not re.search(r"(?:tel|nr|no|num|núm|тел)\.$", before[: cut + 1], re.I):
        before = before[cut + 1 :]
    before = _folded_word(before)
    wanted = _ID_BEFORE if kind == "id_number" else _PHONE_BEFORE
    score = 0.0
    good = [m.start() for m in wanted.finditer(before)]
    bad = [m.start() for m in _OTHER_BEFORE.finditer(before)]
    if good:
        score += 0.8
    if bad and (not good or bad[-1] > good[-1]):
        score -= 1.5
    return score


def _number_kind(v: str, start: int, raw: str) -> str | None:
    """The kind of the number raw at start, if its score suffices."""
    while raw.count("(") < raw.count(")") and raw.endswith(")"):
        raw = raw[:-1]
    letter = raw[-1] if raw[-1:].isalpha() and raw[-1] not in "OolI" else ""
    body = re.sub(r"\s+", " ", raw[: len(raw) - len(letter)]).translate(_OCR)
    digits = re.sub(r"\D", "", body)
    if not 7 <= len(digits) <= 19:
        return None
    shape = re.sub(r"\d", "9", body) + letter
    zero = "0" + shape[1:] if body[0] == "0" else shape
    best: tuple[float, str] | None = None
    for kind, pattern, score in _SHAPES:
        if pattern.fullmatch(shape) or (digits[1] != "0" and pattern.fullmatch(zero)):
            s = score + _context(v, start, kind)
            if kind == "id_number" and letter and len(digits) == 8 and identity_letter(digits + letter):
                s += 0.4
            if best is None or s > best[0]:
                best = (s, kind)
    if best is None and re.fullmatch(r"9{4}(?:[ -]?9{4}){2,3}[ -]?9{0,4}", shape) and luhn(digits):
        best = (1.0 + _context(v, start, "id_number"), "id_number")
    return best[1] if best and best[0] >= ACCEPT else None


def _numbers(v: str, low: str, plain: str) -> Iterator[tuple[str, int, int]]:
    """plain: v without the numbers and timings of cues, all else in its place."""
    near = list(_around_digits(plain, _NUMBER_REACH))
    for m in (m for a, b, n in near if n >= 4 for m in _RUN.finditer(plain, a, b)):
        whole = m.group()
        if sum(c.isdigit() for c in whole) < 4:
            continue
        for raw in (whole, *(whole[: p.start()] for p in list(_PART.finditer(whole))[:-5:-1])):
            if kind := _number_kind(v, m.start(), raw):
                while raw.count("(") < raw.count(")") and raw.endswith(")"):
                    raw = raw[:-1]
                yield kind, m.start(), m.start() + len(raw)
                break
    for sign in (m for a, b, _ in near for m in _CODED.finditer(plain, a, b)):
        if m := _LETTERED.match(v, sign.start()):
            if 0.6 + _context(v, m.start(), "id_number") >= ACCEPT:
                yield "id_number", m.start(), m.end()
        if m := _IBAN.match(v, sign.start()):
            if len(s := m.group().replace(" ", "")) >= 15 and mod97(s):
                yield "id_number", m.start(), m.end()
    # Seven words or more: all but the first and the last stand between what divides them.
    if sum(map(_DIGIT_WORDS.__contains__, low.replace("-", " ").replace(",", " ").split())) >= 5:
        for m in _WORDED.finditer(v):
            yield "phone", m.start(), m.end()


# ---- Addresses ----
_CAP = r"[A-ZÀ-ÖØ-ÞА-ЯЁ][\w'’-]+"
_UNIT = rf"(?:,?{_SP}(?:(?:{_both(UNITS)})\.?{_SP}#?\w{{1,5}}|#{_OPT}\w{{1,5}}))?"
_ABBREVIATED = "|".join(f"{w}\\." for x in "St Ave Rd Ln Ct Dr Blvd Pl Sq Pkwy Hwy".split() for w in (x, x.upper()))
_STREET = f"(?:{_ABBREVIATED}|(?:{_both(STREETS_AFTER)})(?![\\w]))"
_NUM = r"\d(?<![\w/.,:-]\d)\d{0,4}[A-Za-z]?"
_ADDRESSES = (
    re.compile(rf"{_NUM}(?:{_SP}\d/\d)?{_SP}(?:(?:[NSEW]\.|[NSEW][EW]?\.?(?=[ \t])|{_both(SIDES)}){_SP})?(?:{_CAP}{_SP}){{1,2}}?{_STREET}{_UNIT}"),
    re.compile(rf"(?<!\w)(?i:{STREETS_ES}){_OPT}(?:(?i:de{_SP}la|de{_SP}los|de{_SP}las|del|de){_SP})?{_CAP}(?:{_SP}{_CAP})?,?{_SP}(?:(?i:n\.?[ºo°]\.?|núm\.?|número|#){_OPT})?\d{{1,5}}(?:{_OPT}bis)?[A-Za-z]?(?!\w)(?:,{_SP}(?:\d{{1,2}}[.]?[ºª°](?:{_SP}[A-Z](?!\w))?|(?i:piso){_SP}\d+))?"),
    re.compile(rf"[A-ZÄÖÜ](?<!\w[A-ZÄÖÜ])(?!(?i:(?<=d)uring|(?<=s)pring|(?<=s)tring|(?<=b)ring)\b)[\wäöüßÄÖÜ-]*?(?i:{STREETS_DE})(?!\w){_SP}\d{{1,4}}(?:{_OPT}[a-zA-Z])?(?!\w)"),
    re.compile(rf"{_NUM}(?:{_SP}(?i:bis|ter|quater))?,?{_SP}(?i:{STREETS_FR}){_SP}(?:(?i:de{_SP}la|de{_SP}l['’]|des|du|de|d['’]){_OPT})?{_CAP}"),
    re.compile(rf"(?<!\w)(?i:{STREETS_RU}){_OPT}{_CAP}(?:{_SP}{_CAP})?,?{_SP}(?:(?i:д\.|дом){_OPT})?\d{{1,4}}[а-яА-Я]?(?!\w)(?:,{_SP}(?i:кв\.|квартира){_OPT}\d{{1,4}})?"),
)
def _signs(*words: str) -> tuple[str, ...]:
    """The words of the patterns as they are looked for, without those that hold another."""
    w = {x.replace("\\.?", "").replace("\\", "").lower() for x in words}
    return tuple(sorted(x for x in w if not any(y != x and y in x for y in w)))


_SIGNS = (
    _signs(*(f" {w}" for w in STREETS_AFTER.split())),
    *(_signs(*words.split("|")) for words in (STREETS_ES, STREETS_DE, STREETS_FR, STREETS_RU)),
)


#: Characters before and after a digit that can belong to the number or address it is part of.
_NUMBER_REACH, _REACH = 40, 180
#: The timing of a cue, and its number after an empty line: none of the digits can belong to a span.
_TIMING = re.compile(r"\d\d*(?:[:.,]\d+)+[ \t]*-+>[ \t]*\d+(?:[:.,]\d+)+")
_CUE_NUMBER = re.compile(r"(?:\A|\n[ \t]*\n)[ \t]*\d+[ \t]*\n[ \t]*\Z")
_DIGITS = re.compile(r"\d\d*")
#: A house number that a street can follow.
_HOUSE = re.compile(_NUM + r"[ \t\r\n,]")


def _without_cues(v: str) -> str:
    """The text with line ends as \\n in place of the numbers and timings of cues, all in their places."""
    if "\r" in v:
        v = v.replace("\r\n", " \n").replace("\r", "\n")
    if "->" not in v:
        return v
    out, last = [], 0
    for m in _TIMING.finditer(v):
        a = m.start()
        if number := _CUE_NUMBER.search(v, max(last, a - 32), a):
            a = number.start()
        out += (v[last:a], "\n" * (m.end() - a))
        last = m.end()
    out.append(v[last:])
    return "".join(out)


def _around_digits(plain: str, reach: int) -> Iterator[tuple[int, int, int]]:
    """Stretches around the digits and how many are in each, overlapping ones as one."""
    a, b, n = 0, -1, 0
    for m in _DIGITS.finditer(plain):
        i, end = m.span()
        if b < 0 or i - reach > b:
            if b >= 0:
                yield a, b, n
            a, n = max(0, i - reach), 0
        b = end - 1 + reach
        n += end - i
    if b >= 0:
        yield a, b, n


def _addresses(v: str, plain: str) -> Iterator[tuple[int, int]]:
    """plain: v without the numbers and timings of cues, all else in its place.

    Where the pattern begins with the house number, it is tried at those of plain only.
    """
    for a, b, _ in _around_digits(plain, _REACH):
        low = plain[a:b].lower().replace("\n", " ").replace("\t", " ")
        houses = [m.start() for m in _HOUSE.finditer(plain, a, b)]
        for pattern, signs in zip(_ADDRESSES, _SIGNS):
            first = pattern.pattern.startswith(_NUM)
            if (houses or not first) and any(sign in low for sign in signs):
                if not first:
                    for m in pattern.finditer(v, a, b):
                        yield m.start(), m.end()
                    continue
                last = a
                for h in houses:
                    if h >= last and (m := pattern.match(v, h, b)):
                        last = m.end()
                        yield h, last


# ---- Names ----
_NAME = r"(?:[A-ZÀ-ÖØ-ÞА-ЯЁ]['’](?=[A-ZÀ-Þ]))?[A-ZÀ-ÖØ-ÞА-ЯЁ][\w�'’]*(?:-[A-ZÀ-ÖØ-ÞА-ЯЁ][\w�'’]*)*"
#: A capitalised word that something can follow to complete a name: what ends at another mark is none.
_WORD = re.compile(r"(?:[A-ZÀ-ÖØ-ÞА-ЯЁ]['’](?=[A-ZÀ-Þ]))?+[A-ZÀ-ÖØ-ÞА-ЯЁ][\w�'’]*+(?:-[A-ZÀ-ÖØ-ÞА-ЯЁ][\w�'’]*+)*+(?=[ \t\r\n,])")
_PIECE = re.compile(rf"{_SP}(?:({_NAME})(\.)?|((?:{'|'.join(sorted(_PARTICLES | {p.upper() for p in _PARTICLES} | {p.title() for p in _PARTICLES}))}))(?=[ \t\r\n]))")
_COMMA = re.compile(rf",{_SP}({_NAME})")
_LABEL = re.compile(rf"(?:{CREDITS})(?:{_SP}by)?{_OPT}:?{_OPT}$|(?:{INTRODUCTIONS}){_SP}$", re.I)
#: In capitals nothing tells a verb ("ANNA AND WALTER SEALED") or a noun ("6 MARK", "LA PIERRE") from
#: a name; a name does not follow an article, a possessive or a number.
_AND = re.compile(
    r"(?:^|\W)(?:AND|Y|UND|ET|И|THE|MY|YOUR|HIS|HER|OUR|THEIR|LAS?|LES?|LOS|EL|UNA?|UNE|DES|DU|AUX?|MA|MON|TA|TON|SA|SON|CE|CETTE|MI|TU|SU|DER|DIE|DAS|DEN|DEM|EIN|EINE[NMR]?|MEIN(?:E[NMR]?)?|DEIN(?:E[NMR]?)?)\s+$|(?:^|[^\d:.,])\d{1,6}\s+$"
)
_ARTICLE = re.compile(r"(?:^|\W)(?:der|die|das|den|dem|des|ein|eine|einen|einem|einer|mein|meine|meinen|dein|deine|deinen|keine?|the|my|your)\s+$", re.I)
_TITLE = re.compile(rf"(?:^|[^\w])({'|'.join(sorted((re.escape(t) for t in TITLES.split()), key=len, reverse=True))})\.?{_SP}$", re.I)


def _family(w: str) -> bool:
    """Can the word be a family name?"""
    bare = w.replace("’", "'")
    return bare.find("'", 2) < 0 and len(bare.strip("'�")) >= 3 and bare.lower() not in _COMMON and _fold(bare) not in _PLACES and not bare[0].isdigit()


def _may_lead(v: str, w: str, before: str, end: int) -> bool:
    """May w, before a comma and a given name, be a family name? At the start of a sentence it must be
    no common word and no call ("Wait, Anna!"); within one it must not follow an article."""
    if before.rstrip()[-1:].isalpha():
        return not w.isupper() and not _ARTICLE.search(before)
    return len(w) > 4 and "�" not in w and _fold(w) not in _FOLDED_COMMON and v[end : end + 1] != "!"


class _Given(dict):
    """Folded word -> is it a given name? A lost character stands for any letter."""

    def __missing__(self, f: str) -> bool:
        if len(self) > 200_000:
            self.clear()
        known = f in GIVEN
        if not known and "�" in f and len(f.strip("�")) > 1:
            shape = re.compile("".join("." if x[0] == "�" else re.escape(x) for x in re.findall("�+|[^�]+", f)))
            known = any(shape.fullmatch(g) for g in GIVEN)
        self[f] = known
        return known


class _GivenWords(dict):
    """Word as it stands -> is it a given name?"""

    def __missing__(self, word: str) -> bool:
        if len(self) > 200_000:
            self.clear()
        out = self[word] = _GIVEN[_fold(word)]
        return out


_GIVEN = _Given()
_GIVEN_WORDS = _GivenWords()
_CONTEXTS = frozenset(NAME_CONTEXTS.split())
_FOLDED_COMMON = frozenset(map(_folded_word, _COMMON))
_INTRODUCING = frozenset(w.split()[-1] for w in (CREDITS + "|" + INTRODUCTIONS).split("|")) | {"by"}


def _introduced(before: str) -> bool:
    """Does a title, a credit or an introduction end here?"""
    end = before.rstrip()
    if end.endswith(":"):
        return bool(_LABEL.search(before))
    word = end.rpartition(" ")[2].rpartition("\n")[2].rstrip(".").lower()
    return (word in _TITLES and bool(_TITLE.search(before))) or (word in _INTRODUCING and bool(_LABEL.search(before)))


#: The small letters that begin no particle.
_NO_NAME = frozenset("abcdefghijklmnopqrstuvwxyzäöüßáéíóúñàâçèêîôûабвгдежзийклмнопрстуфхцчшщыэюяё") - {p[0] for p in _PARTICLES}


def _shaped(v: str, w: str, before: str, end: int) -> bool:
    """Is w, which is on no list, by its shape and the word before it the first word of a name?

    Two words with one capital each, no common word, title or place, after a verb that takes a person.
    """
    if w.isupper() or len(w) < 3 or w in _PLACE_STARTS or not _family(w):
        return False
    words = before.rsplit(None, 1)
    if not words or before[-1:] != " " or words[-1].lower().lstrip("¿¡«\"'(") not in _CONTEXTS:
        return False
    p = _PIECE.match(v, end)
    return bool(p and p.group(1) and not p.group(1).isupper() and p.group(1).lower() not in _TITLES and _family(p.group(1)))


def _names(v: str) -> Iterator[tuple[int, int]]:
    last = -1
    for m in _WORD.finditer(v):
        if m.start() < last:
            continue
        next_ = v[m.end()]
        w = m.group()
        given = _GIVEN_WORDS[w]
        comma = next_ == ","
        if not given and next_ == " " and v[m.end() + 1 : m.end() + 2] in _NO_NAME:
            continue
        before = v[max(0, m.start() - 32) : m.start()]
        if not given and not _introduced(before) and not _shaped(v, w, before, m.end()):
            # family name first: "Family, Given"
            c = _COMMA.match(v, m.end()) if comma else None
            if c and _GIVEN[_fold(c.group(1))] and _family(w) and _may_lead(v, w, before, c.end()):
                if v[c.end() : c.end() + 1] != "-":
                    last = c.end()
                    yield m.start(), last
            continue
        if not given and (w.lower() in _TITLES or w.lower() in _COMMON):
            continue
        c = _COMMA.match(v, m.end())
        if not given and c and _GIVEN[_fold(c.group(1))] and _family(w):
            last = c.end()
            yield m.start(), last
            continue
        end, family, at = -1, False, m.end()
        while p := _PIECE.match(v, at):
            name, dot, particle = p.group(1), p.group(2), p.group(3)
            if particle or (name and name.lower() in _PARTICLES):
                at = p.end()
                continue
            if name and len(name) == 1 and dot:
                at = p.end()
                continue
            if not name:
                break
            if given and _GIVEN[_fold(name)]:
                at = end = p.end(1)
                continue
            if _family(name) and not (name.isupper() and w.isupper() and (name.endswith(("ED", "ING")) or _AND.search(before))):
                family, end = True, p.end(1)
            break
        if family:
            follows = _PIECE.match(v, end)
            if follows and follows.group(1) and _fold(follows.group(1)) in _PLACES:
                continue
            while v[end - 2 : end].lower() in ("'s", "’s") or v[end - 1] in "'’":
                end -= 2 if v[end - 2 : end].lower() in ("'s", "’s") else 1
            last = end
            yield m.start(), end


def spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the personal information in a text, in order, without overlaps."""
    if not text:
        return []
    v, at = view_of(text)
    low = v.lower()
    found: list[tuple[str, int, int]] = [("email", a, b) for a, b in _mails(v, low)]
    plain = _without_cues(v)
    found += _numbers(v, low, plain)
    found += [("address", a, b) for a, b in _addresses(v, plain)]
    found += [("person", a, b) for a, b in _names(v)]
    found.sort(key=lambda s: (KINDS.index(s[0]), s[1], -s[2]))
    kept: list[tuple[str, int, int]] = []
    for s in found:
        if all(s[2] <= k[1] or s[1] >= k[2] for k in kept):
            kept.append(s)
    if at is not None:
        kept = [(k, at[0][a], at[1][b - 1]) for k, a, b in kept]
    return sorted(kept, key=lambda s: s[1])


_BLANK = re.compile(r"[ \t\r\n]+")


def personal_information(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, kind, span_text): one row for each different span of each document.

    span_text is the span as it stands in the text, runs of white space as one space. Whole texts
    are searched, whatever their length; null and empty texts have no spans; an empty table gives
    no rows; repeated rows give the same spans once an id; other columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def find(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches(rows, 1024):
            row, kinds, out = [], [], []
            for i, text in enumerate(t.column(1).to_pylist()):
                got = {(k, _BLANK.sub(" ", text[a:b])) for k, a, b in spans(text)}
                for k, s in sorted(got):
                    row.append(i)
                    kinds.append(k)
                    out.append(s)
            ids = t.column(0).combine_chunks().take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(kinds, pa.string()), pa.array(out, pa.string())], names=[id_col, "kind", "span_text"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(find, f"`{id_col}` {kind}, kind string, span_text string")


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, text_col) with [EMAIL], [PHONE], [ID_NUMBER], [ADDRESS], [PERSON] in place of spans.

    All else of the text stays as it is; null stays null.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def write(text: str | None) -> str | None:
        if not text:
            return text
        out, last = [], 0
        for k, a, b in spans(text):
            out += (text[last:a], f"[{k.upper()}]")
            last = b
        return "".join(out) + text[last:]

    def change(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches(rows, 1024):
            yield pa.RecordBatch.from_arrays([t.column(0).combine_chunks(), pa.array(map(write, t.column(1).to_pylist()), pa.string())], names=[id_col, text_col])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(change, f"`{id_col}` {kind}, `{text_col}` string")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_information(table(spark, sf_dir, "documents")).distinct()


def p8_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redacted(table(spark, sf_dir, "documents"))
