"""Problem 6: personal information in free text: proposals by regular expressions, validators, and nearby context words.

Plan. Each rule proposes spans of one type with a score. A validator (mod 97 for bank accounts and French social numbers, Luhn for
payment cards and Canadian social numbers, the check digits of tax and resident numbers, area and length rules of telephone
numbers) confirms or refutes the span; words within CONTEXT characters before it (a few after it) raise or lower the score. Spans
that reach ACCEPT are kept; of overlapping ones the better type and then the longer span stays. One scan of the texts, no shuffle.

Names are pairs of words whose evidence adds up: a given name of a list, the ending of the family name, capitals, what stands
before (titles, greetings, `Author:`) or after them (`said`), and a neighbour in an enumeration that is a name. Words that the same
text has in lower case, and words that form like ordinary ones, are no evidence.

Null and blank texts hold nothing and stay as they are. Every occurrence is replaced; a span found twice in a document is
reported once. Existing placeholders such as <EMAIL> or [PHONE] are left alone. Texts are processed whole.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame

ACCEPT, CONTEXT = 0.5, 48
TYPES = ("email", "bank_account", "payment_card", "id_number", "phone", "street_address", "person_name")
PLACEHOLDERS = {"email": "<EMAIL>", "bank_account": "<BANK_ACCOUNT>", "payment_card": "<PAYMENT_CARD>", "id_number": "<ID_NUMBER>", "phone": "<PHONE>", "street_address": "<STREET_ADDRESS>", "person_name": "<PERSON_NAME>"}

# Given names that start a person's name (extend by parameter for other corpora).
GIVEN = (
    "adam agnes aisha alan albert alice amir amy andrea andrew anna anselm anton aurelio barbara ben bettina brian carlos carol catherine charles "
    "chloe christine claire corwin daniel david delia diana donald edward elena elizabeth emeric emily emma erik eva fatima fenna frank gideon george grace "
    "halina hannah hans heinrich helen henry ibrahim imani ines ingrid isabel ismet jack james jan jane jessica john jolanda jonas jose joseph juan julia jurek "
    "karen karl kasimir katherine kevin kofi laura leonie lin linda linh lisa lucas luis maria marie marla mark martin mary mattis mehmet michael ming mohammed nadja "
    "nancy nina noor odile olga oskar pablo patricia paul pedro peter petra pierre priya quirin rafaela rachel ravi rebecca richard robert rosalie ruth salome samuel "
    "sandra sarah simon sophie stefan stephen sunniva susan tamsin thomas tobin ulrik verena victor walter wanda wei william xenia yusra yusuf zelda "
    "ahmed aiko arjun astrid ava carmen deepak diego dmitri elif emil fatou giulia hassan hiroshi igor ivan kenji lars leila liam luca mateo mia mina natalia noah "
    "olivia omar priyanka rahul sanjay sean sofia sven tariq yuki"
).split()
# Endings of family names.
FAMILY_ENDINGS = (
    "stead worth ham ley well wick ström strom stroem ano etti ova ović ovic inski dottir quist mere hollow berg sund son sen ton ford field man mann stein baum "
    "escu enko sson wood shaw land burg feld meyer oğlu"
).split()
# Chinese family names of two characters.
DOUBLE_FAMILY = "欧阳 太史 端木 上官 司马 东方 独孤 南宫 万俟 闻人 夏侯 诸葛 尉迟 公羊 赫连 澹台 皇甫 宗政 濮阳 公冶 太叔 申屠 公孙 慕容 仲孙 钟离 长孙 宇文 司徒 鲜于 司空 令狐 东郭 西门 第五 百里 呼延 轩辕".split()
# Top-level names accepted in addresses that are spelled out.
SPELLED_TOP = "com org net edu gov io de fr cn uk eu us ch at co info dev ai app example test invalid localhost".split()
STREETS = "street st lane ln close road rd avenue ave boulevard blvd drive dr court ct way place terrace square crescent row walk gardens".split()

# Words that are no part of a name, in the languages of the rules.
_NO_WORD = frozenset("and or the a an of to for with from by on in at is was are were has had says wrote und oder der die das et ou le la les de du".split())
_FUNCTION = frozenset(
    "as if so he she it we they you but not no yes when where what why how who which this that these those there here then than all any both each every some please also only just our your my his her its their "
    "im am als wenn aber nicht ein eine wir ihr sie mit von auf für bei zu un une des au aux dans pour par sur avec que qui ne pas nous vous il elle ils".split()
)
_S = r"(?:[^\S\r\n]{1,4}|[^\S\r\n]?\r?\n[^\S\r\n]{0,4})"  # space within a name or address
_DASH = r"[-‐‑–−]"

# ---- validators


def luhn(digits: str) -> bool:
    """Whether the last digit is the Luhn check digit."""
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else sum(divmod(2 * d, 10))
    return total % 10 == 0


def mod97(account: str) -> bool:
    """Whether an account number's check digits are right: rearranged and read as a number it leaves 1 by 97."""
    account = re.sub(r"\W", "", account).upper()
    return len(account) > 4 and account.isalnum() and account.isascii() and int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


def mod11_2(number: str) -> bool:
    """Check character of an 18-character resident identity number."""
    return (sum(int(d) * w for d, w in zip(number[:17], (7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2))) + (10 if number[17] in "xX" else int(number[17]))) % 11 == 1


def mod11_10(digits: str) -> bool:
    """Check digit of an 11-digit tax number."""
    product = 10
    for d in map(int, digits[:-1]):
        product = ((d + product) % 10 or 10) * 2 % 11
    return (11 - product) % 10 == int(digits[-1])


def _digits(text: str) -> str:
    return "".join(c for c in text if c.isdigit())


# ---- rules: (type, base score, expression, validator of the span, cues that raise, cues that lower)

_DIGIT = re.compile(r"\d")
_DIGITS = re.compile(r"\d[\d\s()./·‐‑–−-]{5,}")
_LETTERS = re.compile(r"[^\W\d_]{3,}")
_GLUE = re.compile(r"[\w@.+/-]")
_GLUED = re.compile(r"[\w@]")
_AT = re.compile(r"[@＠]|(?i:(?<=[\s\[({<])at(?=[\s\])}>]))(?=.{3,160}?(?:(?i:dot)|\.))", re.S)


def _windows(spans: list[tuple[int, int]], before: int, after: int, size: int) -> list[tuple[int, int]]:
    """Joined windows around ascending spans."""
    made: list[tuple[int, int]] = []
    for start, end in spans:
        a, b = max(0, start - before), min(size, end + after)
        if made and a <= made[-1][1]:
            made[-1] = (made[-1][0], max(b, made[-1][1]))
        else:
            made.append((a, b))
    return made


def _spelled(span: str, context: str) -> float:
    """A bare word `at` before a host with ordinary dots is prose, unless what precedes it can't be a word."""
    if re.search(r"(?i)\sat\s", span) and not re.search(r"(?i)\Wdot\W", span):
        return 0.0 if re.search(r"[._+\d-]", re.split(r"(?i)\sat\s", span)[0]) else -1
    return 0.0


def _plausible_phone(span: str, context: str) -> float:
    d = _digits(span)
    if not 9 <= len(d) <= 15 or len(set(d)) < 3:
        return -1
    if span[:2] == "00" and len(d) < 11:
        return -1
    return 0.0


def _national(span: str, context: str) -> float:
    """A number without a country code: a trunk prefix and 9 to 12 digits in all."""
    d = _digits(span)
    return _plausible_phone(span, context) if d[0] == "0" and d[1] != "0" and 9 <= len(d) <= 12 else -1


def _resident(span: str, context: str) -> float:
    """A plausible birth date inside is needed; the check character raises the score, but made-up numbers lack it."""
    born = span[6:14]
    dated = "1800" < born[:4] < "2100" and "01" <= born[4:6] <= "12" and "01" <= born[6:] <= "31"
    return (0.2 if dated else -0.3) + 0.2 * mod11_2(span)


def _tax(span: str, context: str) -> float:
    """Grouped digits and a leading 00, which is never issued and so stands in for a real number, speak for a tax number."""
    d = _digits(span)
    return 0.2 * mod11_10(d) + 0.2 * (span != d) + 0.2 * (d[:2] == "00")


def _social(span: str, context: str) -> float:
    """Area 666 and areas from 900 are never issued: what bears them is a stand-in for a number of this kind."""
    d = _digits(span)
    stand_in = d[:3] == "666" or d[0] == "9"
    if not stand_in and (d[3:5] == "00" or d[5:] == "0000" or d[:3] == "000"):
        return -1
    return 0.0 if span != d else (0.1 if d[:3] == "666" else -0.2)


def _french(span: str, context: str) -> float:
    """The key of a French social security number: with it the number leaves 0 by 97; Corsican departments count as 19 and 18."""
    d = re.sub(r"\W", "", span).upper().replace("2A", "19").replace("2B", "18")
    return 0.4 * ((int(d[:13]) + int(d[13:])) % 97 == 0)


def _canadian(span: str, context: str) -> float:
    """A Canadian social insurance number has a Luhn check digit."""
    return 0.2 * luhn(_digits(span))


def _account(span: str, context: str) -> float:
    """Only mod 97 makes an account number of it."""
    return 0.0 if 15 <= len(re.sub(r"\W", "", span)) <= 34 and mod97(span) else -1


def _card(span: str, context: str) -> float:
    """Only Luhn makes a card number of it; digits in groups as on a card are likelier one than a plain run."""
    d = _digits(span)
    return (0.3 if d != span else 0.0) if 13 <= len(d) <= 19 and len(set(d)) > 1 and luhn(d) else -1


_CUE_CARD = re.compile(r"(?i)card|visa|master|amex|karte|carte|credit|debit|卡")
_CUE_FRENCH = re.compile(r"(?i)sécu|\bnir\b|\binsee\b|social|assuré")
_CUE_CANADIAN = re.compile(r"\bSIN\b|(?i:social insurance|assurance sociale)")
_CUE_PHONE = re.compile(r"(?i)tel|phon|fax|call|mobil|handy|\bcell|text|contact|reach|ruf|nummer|number|appel|joindre|kontakt|erreich|电话|手机|联系|传真")
# A bare number of this form is also what somebody is asked for.
_CUE_TAX = re.compile(r"(?i)\btax|steuer|fiscal|\btin\b|税|finanz|\b(?:want|need|require|request|demand|quote|state|enter|provide)(?:s|ed)?\b")
_CUE_SOCIAL = re.compile(r"(?i)\bssn|social|security|birth|member|sozial|sécurité|社保")
_CUE_PASS = re.compile(r"(?i)pass(?:port|eport|nummer|\b)|reisepass|护照|travel doc")
_CUE_ID = re.compile(r"(?i)national|identi|ausweis|身份|证|\bid\b|delete|personal")
_NOT_PHONE = re.compile(r"(?i)(?:version|build|seed|hash|ticket|model|array|id|batch|step|wait|shape|run|issue|line|offset|commit|checksums?)[^a-z0-9]{0,4}$")

_EMAIL_LOCAL = r"[A-Za-z0-9À-ɏ](?:[A-Za-z0-9À-ɏ._%+'-]{0,62}[A-Za-z0-9À-ɏ_+-])?"
_LABEL = r"[A-Za-z0-9À-ɏ](?:[A-Za-z0-9À-ɏ-]{0,61}[A-Za-z0-9À-ɏ])?"
_TOP = r"(?:[A-Za-z]{2,24}|xn--[a-z0-9-]+)"
_PLAIN_EMAIL = re.compile(rf"(?<![\w.+%-]){_EMAIL_LOCAL}(?:[@＠]|[^\S\r\n][@＠][^\S\r\n])(?:{_LABEL}\.)+{_TOP}(?![\w-]|\.\w|[@＠])")
_SPELLED_EMAIL = re.compile(
    rf"(?i)(?<![\w.+%-]){_EMAIL_LOCAL}(?:[^\S\r\n]{{0,2}}[\[({{<][^\S\r\n]?at[^\S\r\n]?[\])}}>][^\S\r\n]{{0,2}}|{_S}at{_S}|[@＠]|[^\S\r\n][@＠][^\S\r\n])"
    rf"{_LABEL}(?:(?:[^\S\r\n]{{0,2}}[\[({{<][^\S\r\n]?dot[^\S\r\n]?[\])}}>][^\S\r\n]{{0,2}}|{_S}dot{_S}|\.){_LABEL}){{0,4}}"
    rf"(?:[^\S\r\n]{{0,2}}[\[({{<][^\S\r\n]?dot[^\S\r\n]?[\])}}>][^\S\r\n]{{0,2}}|{_S}dot{_S}|\.)(?:{'|'.join(SPELLED_TOP)})(?![\w-]|\.\w)"
)
_SEP = rf"(?:[^\S\r\n]|[.·/]|{_DASH})"
_INTERNATIONAL = re.compile(rf"(?<![\w+])(?:\+|00(?=[1-9]))[1-9]\d{{0,2}}{_SEP}?(?:\(\d{{1,4}}\){_SEP}?)?\d{{1,12}}(?:{_SEP}\d{{2,12}}){{0,5}}(?!{_DASH}?\d|\.\d|[^\W\d_])")
_AMERICAN = re.compile(rf"(?<![\w+./,-])(?<!\d )(?:\((?:[2-9]\d\d)\)[^\S\r\n]?|[2-9]\d\d(?=([^\S\r\n]|[.]|{_DASH})\d{{3}}\1\d{{4}})(?:[^\S\r\n]|[.]|{_DASH}))[2-9]\d\d(?:[^\S\r\n]|[.]|{_DASH})\d{{4}}(?![\w/]|{_DASH}\d|\.\d)")
_TRUNK = re.compile(rf"(?<![\w+./,-])(?<!\d[ :])(?:\(0[1-9]\d{{0,4}}\)|0[1-9]\d{{0,4}})(?:{_SEP}\d{{2,8}}){{1,5}}(?![\w/:]|{_DASH}\d|\.\d)")
_SOCIAL = re.compile(rf"(?<![\w.+/])(?<!\d{_DASH})(?<!\d )\d{{3}}(?:([^\S\r\n]|[.]|{_DASH})\d\d\1|\d\d)\d{{4}}(?![\w/]|{_DASH}[\w]|\.\d|[^\S\r\n]\d)")
_INSURANCE = re.compile(rf"(?i)(?<![\w])[a-z]{{2}}({_SEP}?)\d\d\1\d\d\1\d\d\1?[a-d](?![\w])")
_TAX = re.compile(r"(?<![\w.+/,-])(?:\d{11}|\d\d([^\S\r\n]|/|-)\d{3}\1\d{3}\1\d{3})(?![\w/]|[.,-]\d)")
_RESIDENT = re.compile(r"(?<![\w.-])[1-9]\d{16}[\dXx](?![\w-]|\.\d)")
_FRENCH = re.compile(rf"(?<![\w.+/,-])[12]({_SEP}?)\d\d\1(?:0[1-9]|1[0-2]|[2-9]\d)\1(?:\d\d|2[ABab])\1\d{{3}}\1\d{{3}}{_SEP}?\d\d(?![\w/]|[.,-]\d)")
_CANADIAN = re.compile(r"(?<![\w.+/,-])(?<!\d )[1-9]\d\d([ -])\d{3}\1\d{3}(?![\w/]|[ .,-]\d)")
_ACCOUNT = re.compile(r"(?<![\w-])[A-Z]{2}\d{2}(?:[ -]?[A-Z0-9]{4}){2,7}(?:[ -]?[A-Z0-9]{1,4})?(?![\w-])")
_CARD = re.compile(r"(?<![\w.+/-])(?<!\d )[2-6](?:\d{12,18}|\d{3}([ -])\d{4}\1\d{4}\1\d{1,7}|\d{3}([ -])\d{6}\2\d{4,5})(?![\w/-]|[ .,]\d)")
_PASSPORT = re.compile(r"(?<![\w-])[A-Za-z]{1,2}[^\S\r\n]?\d{7}(?![\w-]|\.\d)")

_WORD = r"[^\W\d_]+(?:[’'][^\W\d_]+)?"
_MAJOR = r"(?-i:[A-ZÀ-ÞĀ-Ž])"
_UNIT = r"(?:flat|apt|apartment|suite|unit|room)\.?[^\S\r\n]?#?\d{1,5}[a-z]?"
_STREET = re.compile(
    rf"(?i)(?<![\w.])(?:{_UNIT}[,]?{_S})?(?<![\d.])\d{{1,5}}[a-z]?{_S}(?:{_MAJOR}{_WORD}{_S}){{1,2}}(?:{_MAJOR}(?:{'|'.join(s[1:] for s in STREETS if len(s) > 1)}))\b(?<!\bST)(?:(?<=rd)\.|(?<=ln)\.)?(?:,?{_S}{_UNIT}\b)?"
    .replace(rf"(?:{_MAJOR}(?:{'|'.join(s[1:] for s in STREETS if len(s) > 1)}))\b(?<!\bST)", rf"(?={_MAJOR})(?:{'|'.join(sorted(STREETS, key=len, reverse=True))})\b")
)
_STRASSE = re.compile(rf"(?i)\b{_MAJOR}[^\W\d_]*(?:[^\W\d_]|-)(?:stra(?:ß|ss)e|str\.|weg|platz|allee|gasse|damm|ufer){_S}\d{{1,4}}(?:[^\S\r\n]?[a-z]\b(?!{_S}[a-z]))?(?![\w])")
_RUE = re.compile(rf"(?i)(?<![\w])\d{{1,4}}(?:[^\S\r\n]?(?:bis|ter|quater))?,?{_S}(?:rue|avenue|chemin|boulevard|place|impasse|allée|quai|route){_S}(?:de la |du |des |de l[’']|de |d[’'])?{_MAJOR}{_WORD}(?:-{_WORD})*")
# Where the words of streets stand; addresses are looked for around them.
_STREET_WORD = re.compile("(?<!\\w)(?:" + "|".join(f"{w[0].upper()}(?i:{w[1:]})" for w in sorted(STREETS, key=len, reverse=True)) + ")(?!\\w)")
_STRASSE_WORD = re.compile(r"(?:strasse|str\.|weg|platz|allee|gasse|damm|ufer)(?=\s{1,6}\d)")
_RUE_WORD = re.compile(r"(?:rue|avenue|chemin|boulevard|place|impasse|allée|quai|route)(?=\s)")
_LU = re.compile(r"[一-鿿]{2}(?:大道|胡同|路|街|巷|弄)\d{1,5}号?(?:\d+(?:栋|单元|室|楼))*(?<=[号栋元室楼])")

_CUE_NAME = re.compile(
    r"(?i)(?:attention|attn|contact|author|signed[- ]off[- ]by|reviewe[rd]|with|ask|regards|thanks|filed under|says|from|ist|grüßen|hat|mit|merci|avec|à|by|cc|dear|name|联系人|收件人|审核)\W{0,4}$"
)
# A pair of capitalised words, what introduces a person, what a person does, and what joins one name to the next.
_NAME_WORD = rf"{_MAJOR}(?:[’'])?(?:{_MAJOR})?[a-zß-ÿā-ž]+(?:[’'-]{_MAJOR}?[a-zß-ÿā-ž]+|{_MAJOR}[a-zß-ÿā-ž]+)*"
_PAIR = rf"(?P<name>(?P<a>{_NAME_WORD})[ \t](?:{_MAJOR}\.[ \t])?(?P<b>{_NAME_WORD}))(?![\w@]|[’'](?![sS]\b)|[ \t]{_MAJOR})"
_PAIRS = re.compile(rf"(?<![\w@.+/-]){_PAIR}")
_LEAD = re.compile(
    r"(?<![\w.])(?i:contact|ask|tell|call|ping|dear|hi|hello|hey|thanks to|thank you|met|meet|invite|(?:mr|mrs|ms|dr|prof|mme)\.?|herr|frau|madame|monsieur|bonjour|hallo|liebe[rs]?),?[ \t]{1,2}(?:(?i:mr|mrs|ms|dr|prof)\.?[ \t])?\Z"
)
_SAYS = re.compile(r"[ \t](?:said|wrote|asked|replied|told|confirmed|emailed|lives|sagte|schrieb|fragte)\b")
_NEXT = re.compile(rf"(?:,|,?[ \t](?:and|or|und|oder|et|ou|&))[ \t]{_PAIR}")
_BEFORE = re.compile(rf"(?<![\w@.+/-]){_PAIR}(?:,|,?[ \t](?:and|or|und|oder|et|ou|&))[ \t]\Z")
_ORDINARY = re.compile(r"(?:ing|tion|sion|ment|ness|able|ible|ally|ward|less|ful|ance|ence|ism|ity|ware|base|list|map|tree|sort|search|value|error|type|ung|heit|keit|schaft|lich|ique|eur|tique)s?\Z")
_CJK_FAMILY = "王李张刘陈杨黄赵吴周徐孙马朱胡郭何高林罗郑梁谢宋唐许韩冯邓曹彭曾萧田董袁潘于蒋蔡余杜叶程苏魏吕丁任沈姚卢姜崔钟谭陆汪范金石廖贾夏韦方白邹孟熊秦邱江尹薛闫段雷侯龙史陶黎贺顾毛郝龚邵万钱严武戴"
_CJK_PERSON = re.compile(rf"(?:(?:联系|感谢|询问|请|与)(?P<x>[{_CJK_FAMILY}][一-鿿]{{1,2}}?)(?=说|表示|先生|女士|老师|经理|工程师))|(?<![一-鿿])(?P<y>[{_CJK_FAMILY}][一-鿿]{{1,2}})(?=先生|女士|老师|经理|工程师)")
# What nearly always stands before a person's name, which is then taken whatever the lists say; words that make it no name.
_SIGNED = re.compile(
    rf"(?:(?i:(?:signed[- ]off|reviewed|acked|tested|reported|suggested|co-authored)[- ]by|author|full name|attn|attention|contact(?: person)?|autor|ansprechpartner(?:in)?|kontakt|auteur){_S}?:|(?i:(?:regards|sincerely|grüßen|grüße|cordialement),?)){_S}?"
    rf"(?P<name>{_MAJOR}(?:\.[ \t]?|{_WORD}[ \t])(?:{_MAJOR}\.?[ \t]|{_MAJOR}{_WORD}[ \t](?={_MAJOR}{_WORD}[ \t]{{0,2}}(?:[\r\n<,(;.]|\Z)))?{_MAJOR}{_WORD}(?:-{_MAJOR}{_WORD})?)(?![\w@])"
)
_SIGNED_WORDS = ("ed-by", "ed by", "off-by", "off by", "author", "full name", "full\nname", "attn", "attention", "contact", "autor", "ansprech", "kontakt", "auteur", "regards", "sincerely", "grüss", "cordial")
_SIGNED_CJK = re.compile(r"(?:联系人|收件人|审核人?|姓名|作者|签名)(?:是|为)?[\s:：]{0,2}(?P<name>[一-鿿]{2,4}?)(?=$|[^一-鿿]|电话|手机|先生|女士|的)")
_NO_NAME = frozenset("team support group department desk office service services sales list customer help human resources project committee staff admin center centre us me the our your "
    "bank company inc ltd gmbh corp institute university school college council ministry agency foundation society union club board platform data system systems server cluster "
    "engine cloud world global national international open source north south east west street road city county state new".split())


def _family(word: str, endings: tuple[str, ...]) -> bool:
    low = word.casefold()
    return any(low.endswith(e) and len(low) - len(e) >= 3 for e in endings)


class Finder:
    """Finds (start, end, type) in a text. Rules are compiled once per worker."""

    def __init__(self, given: tuple[str, ...] = tuple(GIVEN), endings: tuple[str, ...] = tuple(FAMILY_ENDINGS)) -> None:
        self.given, self.endings = frozenset(given), tuple(endings)
        first = "|".join(sorted(self.given, key=len, reverse=True))
        tail = "|".join(sorted(self.endings, key=len, reverse=True))
        middle = rf"(?:[^\W\d_]\.?{_S})?"
        stop = r"(?![\w@])"
        self.forward = re.compile(rf"(?i)(?:{first}){_S}{middle}(?P<family>{_WORD}(?:-{_WORD})?){stop}")
        self.backward = re.compile(rf"(?i)(?P<family>[^\W\d_]{{3,}}(?:{tail})),?{_S}(?:{first})\b(?:{_S}[^\W\d_]\.)?{stop}")
        self.trailing = re.compile(rf"(?i)(?P<family>[^\W\d_]{{3,}}(?:{tail})),?{_S}(?P<initial>[^\W\d_])\.(?!\w)")
        self.initial = re.compile(rf"(?i)(?<![\w@.+/-])(?P<initial>[^\W\d_])\.{_S}?{middle}\Z")
        self.double = re.compile(rf"(?:{'|'.join(DOUBLE_FAMILY)})[一-鿿]{{2}}")
        self.known: set[str] = set()
        self.telling: set[str] = set()

    def _seen(self, words: set[str]) -> set[str]:
        """Those of the words that a name may have: given names and words with the ending of a family name."""
        if len(self.known) > 300_000:
            self.known.clear()
            self.telling.clear()
        for word in words - self.known:
            self.known.add(word)
            low = word.casefold()
            if low in self.given or _family(low, self.endings):
                self.telling.add(word)
        return words & self.telling

    def _plain(self, word: str, words: set[str]) -> bool:
        """Whether a capitalised word is an ordinary one: it stands in lower case in the same text, or is formed like one."""
        low = word.casefold()
        return low not in self.given and (low in words or low in _NO_WORD or low in _FUNCTION or low in _NO_NAME or bool(_ORDINARY.search(low)))

    def _listed(self, text: str, words: set[str]) -> Iterator[tuple[int, int, float]]:
        """Names that the lists propose."""
        for w in self._seen(words):
            given, at, low = w.casefold() in self.given, -1, w.casefold()
            while (at := text.find(w, at + 1)) >= 0:
                if (at and text[at - 1].isalpha()) or text[at + len(w) : at + len(w) + 1].isalpha():
                    continue
                free, end_of_word = at == 0 or not _GLUE.match(text[at - 1]), at + len(w)
                found: list[tuple[re.Match, int, int, float]] = []
                if given and free and (m := self.forward.match(text, at)):
                    found.append((m, m.start(), m.end(), 0.3))
                if not given:
                    if free and (m := self.backward.match(text, at)):
                        found.append((m, m.start(), m.end(), 0.4))
                    elif free and (m := self.trailing.match(text, at)):
                        found.append((m, m.start(), m.end(), 0.0))
                    if at and not text[at - 1].isalnum() and (m := self.initial.search(text[max(0, at - 12) : at])) and not _GLUED.match(text, end_of_word):
                        found.append((m, max(0, at - 12) + m.start(), end_of_word, 0.1))
                for m, start, end, score in found:
                    family = m.groupdict().get("family") or w
                    if family[-2:-1] in ("'", "’") and family[-1] in "sS":
                        family, end = family[:-2], end - 2
                    if family.casefold() in _NO_WORD or family.casefold() in self.given:
                        continue
                    score += 0.3 * _family(family, self.endings) + 0.1 * family[:1].isupper()
                    if "initial" in m.re.groupindex:
                        score += 0.1 * m["initial"].isupper()
                    elif given and w[0].isupper() and w[1:].islower() and low not in words and family[:1].isupper() and not family.isupper() and not self._plain(family, words):
                        score += 0.1
                    if _CUE_NAME.search(text, max(0, start - 24), start):
                        score += 0.1
                    yield start, end, score

    def _names(self, text: str) -> list[tuple[int, int, float]]:
        """Proposed names with their scores."""
        words = set(_LETTERS.findall(text))
        made = list(self._listed(text, words))
        if not text.isascii():
            made += [(m.start(), m.end(), 0.6) for m in self.double.finditer(text)]
            made += [(*m.span(m.lastgroup), 0.5) for m in _CJK_PERSON.finditer(text)]

        todo = [n[:2] for n in made if n[2] >= ACCEPT - 1e-9]
        taken = set(todo)

        def propose(m: re.Match, shift: int = 0) -> None:
            """Takes a pair without a word of the lists, unless it is ordinary words or overlaps with a name."""
            a, b = m.start("name") + shift, m.end("name") + shift
            if not (self._plain(m["a"], words) or self._plain(m["b"], words) or any(a < y and x < b for x, y in taken)):
                taken.add((a, b))
                todo.append((a, b))
                made.append((a, b, 0.5))

        for m in _PAIRS.finditer(text):
            start = m.start("name")
            if _SAYS.match(text, m.end("name")) or (start and text[start - 1] in " \t" and _LEAD.search(text, max(0, start - 24), start)):
                propose(m)
        while todo:  # names beside names
            start, end = todo.pop()
            if m := _NEXT.match(text, end):
                propose(m)
            if m := _BEFORE.search(text[max(0, start - 60) : start]):
                propose(m, max(0, start - 60))
        return made

    def _signed(self, text: str, low: str) -> Iterator[tuple[int, int]]:
        """Names after a strong cue."""
        if not text.isascii():
            for m in _SIGNED_CJK.finditer(text):
                yield m.span("name")
        if any(w in low for w in _SIGNED_WORDS):
            for m in _SIGNED.finditer(text):
                start, end = m.span("name")
                end -= 2 * (m["name"][-2] in "'’" and m["name"][-1] in "sS")
                if not any(w in _NO_NAME or w in _NO_WORD for w in re.findall(r"\w+", m["name"].casefold())):
                    yield start, end

    def spans(self, text: str | None) -> list[tuple[int, int, str]]:
        """Accepted spans in order, not overlapping."""
        if not text:
            return []
        proposals: list[tuple[int, int, str, float]] = []

        def propose(kind: str, base: float, rule: re.Pattern, check: Callable[[str, str], float] | None = None, cue: re.Pattern | None = None, against: re.Pattern | None = None, within: list[tuple[int, int]] | None = None) -> None:
            for low, high in [(0, len(text))] if within is None else within:
                for m in rule.finditer(text, low, high):
                    before = text[max(0, m.start() - CONTEXT) : m.start()]
                    score = base + (check(m[0], before) if check else 0)
                    if cue and (cue.search(before) or cue.search(text, m.end(), m.end() + 20)):
                        score += 0.3
                    if against and against.search(before):
                        score -= 0.4
                    proposals.append((*m.span(), kind, score))

        low = text.casefold()
        ats = [m.span() for m in _AT.finditer(text)]
        if ats:
            near = _windows(ats, 80, 200, len(text))
            propose("email", 1, _PLAIN_EMAIL, within=near)
            propose("email", 0.9, _SPELLED_EMAIL, _spelled, within=near)
        runs = [m.span() for m in _DIGITS.finditer(text)]
        if runs:
            near = _windows(runs, 8, 8, len(text))
            propose("bank_account", 0.9, _ACCOUNT, _account, within=_windows(runs, 12, 40, len(text)))
            propose("payment_card", 0.3, _CARD, _card, _CUE_CARD, within=near)
            propose("phone", 0.7, _INTERNATIONAL, _plausible_phone, _CUE_PHONE, within=near)
            propose("phone", 0.6, _AMERICAN, _plausible_phone, _CUE_PHONE, _NOT_PHONE, near)
            propose("phone", 0.6, _TRUNK, _national, _CUE_PHONE, _NOT_PHONE, near)
            propose("id_number", 0.5, _SOCIAL, _social, _CUE_SOCIAL, _NOT_PHONE, near)
            propose("id_number", 0.7, _INSURANCE, within=near)
            propose("id_number", 0.2, _TAX, _tax, _CUE_TAX, within=near)
            propose("id_number", 0.2, _FRENCH, _french, _CUE_FRENCH, within=near)
            propose("id_number", 0.1, _CANADIAN, _canadian, _CUE_CANADIAN, within=near)
            propose("id_number", 0.4, _RESIDENT, _resident, _CUE_ID, within=near)
            propose("id_number", 0.2, _PASSPORT, None, _CUE_PASS, within=near)
        if _DIGIT.search(text):
            lower = low if len(low) == len(text) else None  # else letters were folded into several, and places differ
            for rule, word, there, before, after in ((_STREET, _STREET_WORD, text, 160, 60), (_STRASSE, _STRASSE_WORD, lower, 80, 20), (_RUE, _RUE_WORD, lower, 40, 160)):
                if there is None:
                    propose("street_address", 0.6, rule)
                elif found := [m.span() for m in word.finditer(there)]:
                    propose("street_address", 0.6, rule, within=_windows(found, before, after, len(text)))
            if not text.isascii():
                propose("street_address", 0.6, _LU)
        names = [n for n in self._names(text) if n[2] >= ACCEPT - 1e-9]
        proposals.extend((a, b, "person_name", s) for a, b, s in names)
        proposals.extend((a, b, "person_name", 0.6) for a, b in self._signed(text, low) if all(b <= x or y <= a for x, y, _ in names))
        kept: list[tuple[int, int, str]] = []
        order = {t: i for i, t in enumerate(TYPES)}
        for a, b, kind, _ in sorted((p for p in proposals if p[3] >= ACCEPT - 1e-9), key=lambda p: (order[p[2]], p[0] - p[1])):
            if all(b <= x or y <= a for x, y, _ in kept):
                kept.append((a, b, kind))
        return sorted(kept)


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with a typed placeholder in each place, otherwise unchanged."""
    made, at = [], 0
    for a, b, kind in spans:
        made += [text[at:a], PLACEHOLDERS[kind]]
        at = b
    return "".join(made) + text[at:]


@functools.cache
def _finder(given: tuple[str, ...], endings: tuple[str, ...]) -> Finder:
    return Finder(given, endings)


def _found(given: tuple[str, ...], endings: tuple[str, ...], types: frozenset[str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = _finder(given, endings)
        for batch in batches:
            rows = [(i, *r) for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()) for r in dict.fromkeys((k, t[a:b]) for a, b, k in finder.spans(t) if k in types)]
            columns = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.string(), pa.string()))], ["doc_id", "pii_type", "pii_text"])

    return run


def _redacted(given: tuple[str, ...], endings: tuple[str, ...]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = _finder(given, endings)
        for batch in batches:
            texts = [t if t is None else redact(t, finder.spans(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return run


def find_pii(documents: DataFrame, given: Sequence[str] = GIVEN, endings: Sequence[str] = FAMILY_ENDINGS, types: Sequence[str] = TYPES) -> DataFrame:
    """(doc_id, pii_type, pii_text): each distinct span of a type in a document once. documents: doc_id bigint, text string.

    given and endings are the given names and the endings of family names that propose names, in lower case; types are those reported.
    """
    return documents.select("doc_id", "text").mapInArrow(_found(tuple(given), tuple(endings), frozenset(types)), "doc_id long, pii_type string, pii_text string")


def redact_pii(documents: DataFrame, given: Sequence[str] = GIVEN, endings: Sequence[str] = FAMILY_ENDINGS) -> DataFrame:
    """(doc_id, text) with typed placeholders; texts without findings, nulls included, come back as they were. Lists as in find_pii."""
    return documents.select("doc_id", "text").mapInArrow(_redacted(tuple(given), tuple(endings)), "doc_id long, text string")
