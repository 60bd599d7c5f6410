"""Reading rules for digits in Chinese customer-service text.

The rules are an ordered table of (pattern, reading): the longer and more specific come
first and each sees what the ones before left. Readings need a callback on the
match, which Catalyst's regexp_replace lacks, so the engine runs them in one Arrow UDF.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import cache, lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import each

DIGITS = "0123456789"
PLAIN = str.maketrans(DIGITS, "零一二三四五六七八九")
PHONE = str.maketrans(DIGITS, "零幺二三四五六七八九")
_UNITS = ((1000, "千"), (100, "百"), (10, "十"))


def read_digits(column: Column | str, phone: bool = False) -> Column:
    """Every digit as a numeral; ``phone`` reads 1 as it is read in numbers to dial."""
    return F.translate(column, DIGITS, "零幺二三四五六七八九" if phone else "零一二三四五六七八九")


def cardinal(n: int) -> str | None:
    """1 to 9999 in words, None outside that range."""
    if not 0 < n < 10_000:
        return None
    out, rest, gap = "", n, False
    for unit, name in _UNITS:
        digit, rest = divmod(rest, unit)
        if digit:
            lead = "" if unit == 10 and digit == 1 else "零一二三四五六七八九"[digit]
            out += ("零" if gap else "") + lead + name
            gap = False
        elif out and rest:
            gap = True
    if rest:
        out += ("零" if gap else "") + "零一二三四五六七八九"[rest]
    return out


def _any(*words: str) -> str:
    return "(?:" + "|".join(words) + ")"


_ALONE, _END = r"(?<![0-9A-Za-z])", r"(?![0-9A-Za-z])"
_IS = r"(?:[是为：:，,]|\s)*"
_NOT_A_UNIT = "(?!" + "|".join(("[Hh][Zz]", "[Bb](?:/?[Ss])?(?:[Pp][Ss])?", "[Pp][Xx]")) + ")"
_HOTLINES = {
    "10086": ("中国移动",),
    "10010": ("中国联通", "联通(?![营业])"),
    "10000": ("中国电信", "电信(?![营业])"),
    "10099": ("中国广电",),
    "95588": ("工商银行", "工行"),
    "95533": ("建设银行", "建行"),
    "95599": ("农业银行", "农行"),
    "95566": ("中国银行", "中行"),
    "95559": ("交通银行", "交行"),
    "95555": ("招商银行", "招行"),
    "95580": ("邮储银行", "邮储"),
    "95595": ("光大银行", "光大"),
    "95568": ("民生银行", "民生"),
    "95561": ("兴业银行", "兴业"),
    "95558": ("中信银行", "中信"),
    "95528": ("浦发银行", "浦发"),
    "95511": ("平安银行", "平安"),
}
_MOBILE = r"1[3-9]\d{9}"
_MOBILE_LEADS = tuple(f"1{d}" for d in range(3, 10))
_MOBILE_CONTEXT = _any(
    _any("您的", "来电", "本机", "联系", "绑定", "预留", "登记", "认证", "验证") + _any("手机号码?", "电话(?:号码)?"),
    _any("手机", "电话") + "(?:号码)?",
    "联系" + _any("方式", "电话"),
    "(?:请(?:您)?)?" + _any("确认", "核对") + "(?:一下)?" + _any("手机", "电话", "手机号码?"),
    _any("号码", "电话", "手机号") + _any("为", "是", "：", ":"),
)
_YOU_ARE = _any("您是", "请问您是", "跟您确认您是", "麻烦您确认您是", "跟您核对您是", *(f"{v}(?:一下)?[，,。.]?\\s*您是" for v in ("确认", "核对")))
_TAIL = _any(
    "(?:手机|电话|本机|注册|绑定|银行)?(?:卡)?尾号",
    "(?:银行卡|储蓄卡|信用卡|借记卡)?(?:号)?后[四4]位",
    "末[四4]位",
    "(?:身份证|证件)(?:号)?后[四4]位",
    "(?:账号|卡号)后[四4]位",
)

#: A pattern, its reading, and strings of which any match has one at least: without them the pattern need not be tried.
Rule = tuple[re.Pattern, Callable[[re.Match], str], tuple[str, ...]]


def _spoken(pattern: str, phone: bool, *needs: str) -> Rule:
    """Reads the digits of group ``n``, leaving the rest of the match alone."""
    table = PHONE if phone else PLAIN

    def read(m: re.Match) -> str:
        a, b = m.start("n") - m.start(), m.end("n") - m.start()
        whole = m.group()
        return whole[:a] + re.sub(r"[\s\-]", "", m.group("n")).translate(table) + whole[b:]

    return re.compile(pattern), read, needs


def _bandwidth(m: re.Match) -> str:
    words = cardinal(int(m.group("n")))
    return words + "兆" if words else m.group()


def _gigabit(m: re.Match) -> str:
    n = int(m.group("n"))
    words = "" if n == 1 else cardinal(n)
    return m.group() if words is None else words + "千兆"


def _key(m: re.Match) -> str:
    return m.group("verb") + {"*": "星号", "#": "井号"}.get(m.group("n"), m.group("n").translate(PLAIN))


_PHONE_LENGTHS = frozenset((5, 6, 8, 10, 11, 12))


def _dial(m: re.Match) -> str:
    digits = m.group("n")
    if len(digits) not in _PHONE_LENGTHS or (len(digits) == 11 and digits[0] != "1"):
        return m.group()
    return m.group("verb") + digits.translate(PHONE)


@cache
def rules() -> tuple[Rule, ...]:
    after_m = r"(?=[\s,，.。!！?？:：、；|\]]|$|[一-鿿])"
    after_g = "(?=(?:的|是)?" + _any("带宽", "光纤", "宽带", "套餐", "速率", "网络", "网速", "提速") + ")"
    out: list[Rule] = [
        (re.compile(r"(?P<n>\d{1,4})\s*[Mm]" + _NOT_A_UNIT + after_m), _bandwidth, ("M", "m")),
        (re.compile(r"(?P<n>\d{1,2})\s*[Gg]" + _NOT_A_UNIT + after_g), _gigabit, ("G", "g")),
    ]
    out += [_spoken(_any(*brands) + r"[\s：:,，]*?(?P<n>" + number + ")" + _END, True, number) for number, brands in _HOTLINES.items()]
    out += [_spoken(_ALONE + rf"(?P<n>{lead}[\s\-]?\d{{3}}[\s\-]?\d{{4}})" + _END, True, lead) for lead in ("400", "800")]
    out += [_spoken(_ALONE + rf"(?P<n>{lead}\d{{3}})" + _END, True, lead) for lead in ("95", "12")]
    out += [
        _spoken(_MOBILE_CONTEXT + r"[\s：:,，是为]*(?P<n>" + _MOBILE + ")" + _END, True, *_MOBILE_LEADS),
        _spoken(_YOU_ARE + r"[\s：:,，]*(?P<n>" + _MOBILE + r")\s*号码", True, "您是"),
        _spoken(_TAIL + r"[\s：是为，,]*?(?P<n>\d{3,8})" + _END, False, "尾号", "后四位", "后4位", "末四位", "末4位"),
        _spoken(r"(?:手机)?尾号[\s：:,，]*(?P<n>\d{3,8})" + _END, False, "尾号"),
        _spoken(_any("(?:短信)?验证码", "动态(?:口令|密码)", "校验码", "(?:支付|查询|登录)密码") + _IS + r"(?P<n>\d{4,8})" + _END, True, "验证码", "动态", "校验码", "密码"),
        _spoken(_any("工单", "订单", "案件", "受理单", "业务", "参考") + "号(?:码)?" + _IS + r"(?P<n>\d{6,22})" + _END, True, "工单", "订单", "案件", "受理单", "业务", "参考"),
        _spoken("分机(?:号)?" + _IS + r"(?P<n>\d{2,5})" + _END, False, "分机"),
        _spoken(_any("邮政编码", "邮编") + _IS + r"(?P<n>\d{6})" + _END, False, "邮政编码", "邮编"),
        _spoken(_any("坐席", "客服", "工号", "员工编号", "服务专员") + _IS + r"(?P<n>\d{3,8})" + _END, True, "坐席", "客服", "工号", "员工编号", "服务专员"),
        (re.compile("(?P<verb>(?:请(?:您)?)?" + _any("按", "再按", "接下来按", "选择") + r")\s*(?P<n>[0-9*#])(?:\s*号)?键?"), _key, ("按", "选择")),
        (
            re.compile("(?P<verb>(?:请(?:您)?)?(?:可(?:以)?)?" + _any("拨打", "致电", "联系", "咨询", "呼叫") + r"(?:客服)?(?:热线)?(?:电话)?[\s：:,，]*)(?P<n>\d{5,12})" + _END),
            _dial,
            ("拨打", "致电", "联系", "咨询", "呼叫"),
        ),
        _spoken(_ALONE + f"(?P<n>{_MOBILE})" + _END, True, *_MOBILE_LEADS),
    ]
    return tuple(out)


@cache
def _needed() -> frozenset[str]:
    """The characters of all strings that rules need."""
    return frozenset(ch for _, _, needs in rules() for ch in "".join(needs))


@lru_cache(1 << 14)
def _candidates(there: frozenset[str]) -> tuple[tuple[int, re.Pattern, Callable[[re.Match], str]], ...]:
    """The rules, with their places, that may match a text that has these of the needed characters."""
    return tuple((i, pattern, reading) for i, (pattern, reading, needs) in enumerate(rules()) if any(there.issuperset(s) for s in needs))


def read_numbers(text: str) -> str:
    """All rules in order; those whose characters are not there are passed over, which is settled anew after each change."""
    done = 0
    while True:
        for place, pattern, reading in _candidates(_needed() & set(text)):
            if place >= done:
                done = place + 1
                new = pattern.sub(reading, text)
                if new != text:
                    text = new
                    break
        else:
            return text


def read_customer_service_numbers(column: Column | str, enabled: bool = True) -> Column:
    """STRF-03: all rule families in order; rows without a digit go to Python as nulls."""
    c = F.col(column) if isinstance(column, str) else column
    digits = c.rlike("[0-9]")
    return F.when(digits, each(read_numbers, T.StringType(), F.when(digits, c))).otherwise(c) if enabled else c
