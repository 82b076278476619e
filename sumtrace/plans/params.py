"""Query parameters: the standard defaults, the values for the small test tables, domains."""

from __future__ import annotations

from datetime import date
from types import SimpleNamespace

# The standard default of each parameter.
STANDARD = {
    "q01": dict(cutoff=date(1998, 9, 2)),
    "q02": dict(size=15, type_suffix="BRASS", region="EUROPE"),
    "q03": dict(segment="BUILDING", day=date(1995, 3, 15)),
    "q04": dict(start=date(1993, 7, 1)),
    "q05": dict(region="ASIA", start=date(1994, 1, 1)),
    "q06": dict(start=date(1994, 1, 1), discount=6, quantity=24),
    "q07": dict(nation_1="FRANCE", nation_2="GERMANY"),
    "q08": dict(nation="BRAZIL", region="AMERICA", type="ECONOMY ANODIZED STEEL"),
    "q09": dict(color="green"),
    "q10": dict(start=date(1993, 10, 1)),
    "q11": dict(nation="GERMANY", fraction="0.0001"),
    "q12": dict(mode_1="MAIL", mode_2="SHIP", start=date(1994, 1, 1)),
    "q13": dict(word_1="special", word_2="requests"),
    "q14": dict(start=date(1995, 9, 1)),
    "q15": dict(start=date(1996, 1, 1)),
    "q16": dict(brand="Brand#45", type_prefix="MEDIUM POLISHED", sizes=(49, 14, 23, 45, 19, 3, 36, 9)),
    "q17": dict(brand="Brand#23", containers=("MED BOX",)),
    "q18": dict(quantity=300),
    "q19": dict(brands=("Brand#12", "Brand#23", "Brand#34"), quantities=(1, 10, 20)),
    "q20": dict(color="forest", start=date(1994, 1, 1), nation="CANADA"),
    "q21": dict(nation="SAUDI ARABIA"),
    "q22": dict(codes=("13", "31", "23", "29", "30", "18", "17"), orders_since=None),
}

# The test tables use other names and later dates than the standard ones.
SMALL = {
    "q01": dict(cutoff=date(2001, 9, 2)),
    "q02": dict(size=15, type_suffix="MEDIUM", region="EUROPE"),
    "q03": dict(segment="BUILDING", day=date(1998, 3, 15)),
    "q04": dict(start=date(1996, 7, 1)),
    "q05": dict(region="ASIA", start=date(1996, 1, 1)),
    "q06": dict(start=date(1996, 1, 1), discount=6, quantity=24),
    "q07": dict(nation_1="NATION_6", nation_2="NATION_7"),
    "q08": dict(nation="NATION_6", region="AMERICA", type="ECONOMY"),
    "q09": dict(color="blue"),
    "q10": dict(start=date(1996, 10, 1)),
    "q11": dict(nation="NATION_7", fraction="0.001"),
    "q12": dict(mode_1="MAIL", mode_2="SHIP", start=date(1996, 1, 1)),
    "q13": dict(word_1="special", word_2="requests"),
    "q14": dict(start=date(1996, 1, 1)),
    "q15": dict(start=date(1996, 1, 1)),
    "q16": dict(brand="Brand#5", type_prefix="MEDIUM", sizes=(49, 14, 23, 45, 19, 3, 36, 9)),
    "q17": dict(
        brand="Brand#23",
        containers=tuple(
            f"MED {kind}" for kind in ("CASE", "BOX", "BAG", "JAR", "PKG", "PACK", "CAN", "DRUM")
        ),
    ),
    "q18": dict(quantity=300),
    "q19": dict(brands=("Brand#12", "Brand#23", "Brand#14"), quantities=(1, 10, 20)),
    "q20": dict(color="blue", start=date(1996, 1, 1), nation="NATION_3"),
    "q21": dict(nation="NATION_20"),
    "q22": dict(codes=("13", "31", "23", "29", "30", "18", "17"), orders_since=date(2000, 6, 1)),
}

PROFILES = {"standard": STANDARD, "small": SMALL}

# The domains that parameters are drawn from.
REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
MODES = ["REG AIR", "AIR", "RAIL", "TRUCK", "MAIL", "FOB", "SHIP"]
WORDS_1 = ["special", "pending", "unusual", "express"]
WORDS_2 = ["packages", "requests", "accounts", "deposits"]
TYPE_1 = ["STANDARD", "SMALL", "MEDIUM", "LARGE", "ECONOMY", "PROMO"]
TYPE_2 = ["ANODIZED", "BURNISHED", "PLATED", "POLISHED", "BRUSHED"]
TYPE_3 = ["TIN", "NICKEL", "BRASS", "STEEL", "COPPER"]
NATION_REGION = {
    "ALGERIA": "AFRICA", "ARGENTINA": "AMERICA", "BRAZIL": "AMERICA", "CANADA": "AMERICA",
    "EGYPT": "MIDDLE EAST", "ETHIOPIA": "AFRICA", "FRANCE": "EUROPE", "GERMANY": "EUROPE",
    "INDIA": "ASIA", "INDONESIA": "ASIA", "IRAN": "MIDDLE EAST", "IRAQ": "MIDDLE EAST",
    "JAPAN": "ASIA", "JORDAN": "MIDDLE EAST", "KENYA": "AFRICA", "MOROCCO": "AFRICA",
    "MOZAMBIQUE": "AFRICA", "PERU": "AMERICA", "CHINA": "ASIA", "ROMANIA": "EUROPE",
    "SAUDI ARABIA": "MIDDLE EAST", "VIETNAM": "ASIA", "RUSSIA": "EUROPE",
    "UNITED KINGDOM": "EUROPE", "UNITED STATES": "AMERICA",
}
CONTAINERS = [
    f"{size} {kind}"
    for size in ("SM", "LG", "MED", "JUMBO", "WRAP")
    for kind in ("CASE", "BOX", "BAG", "JAR", "PKG", "PACK", "CAN", "DRUM")
]
BRANDS = [f"Brand#{m}{n}" for m in range(1, 6) for n in range(1, 6)]


def _month_start(first: date, last: date):
    return lambda v: first <= v <= last and v.day == 1


def _year_start(v: date) -> bool:
    return 1993 <= v.year <= 1997 and (v.month, v.day) == (1, 1)


def _distinct(values, count: int, domain) -> bool:
    return len(values) == count == len(set(values)) and all(v in domain for v in values)


def _word(v: str) -> bool:
    return v.isalpha() and v.islower()


DOMAINS = {
    "q01": dict(cutoff=lambda v: 60 <= (date(1998, 12, 1) - v).days <= 120),
    "q02": dict(
        size=lambda v: 1 <= v <= 50,
        type_suffix=TYPE_3.__contains__,
        region=REGIONS.__contains__,
    ),
    "q03": dict(
        segment=SEGMENTS.__contains__, day=lambda v: (v.year, v.month) == (1995, 3)
    ),
    "q04": dict(start=_month_start(date(1993, 1, 1), date(1997, 10, 1))),
    "q05": dict(region=REGIONS.__contains__, start=_year_start),
    "q06": dict(
        start=_year_start, discount=lambda v: 2 <= v <= 9, quantity=lambda v: v in (24, 25)
    ),
    "q07": dict(nation_1=NATION_REGION.__contains__, nation_2=NATION_REGION.__contains__),
    "q08": dict(
        nation=NATION_REGION.__contains__,
        region=REGIONS.__contains__,
        type=lambda v: _type(v, 3),
    ),
    "q09": dict(color=_word),
    "q10": dict(start=_month_start(date(1993, 2, 1), date(1995, 1, 1))),
    "q11": dict(nation=NATION_REGION.__contains__, fraction=lambda v: 0 < float(v) <= 0.0001),
    "q12": dict(mode_1=MODES.__contains__, mode_2=MODES.__contains__, start=_year_start),
    "q13": dict(word_1=WORDS_1.__contains__, word_2=WORDS_2.__contains__),
    "q14": dict(start=_month_start(date(1993, 1, 1), date(1997, 12, 1))),
    "q15": dict(start=_month_start(date(1993, 1, 1), date(1997, 10, 1))),
    "q16": dict(
        brand=BRANDS.__contains__,
        type_prefix=lambda v: _type(v, 2),
        sizes=lambda v: _distinct(v, 8, range(1, 51)),
    ),
    "q17": dict(brand=BRANDS.__contains__, containers=lambda v: _distinct(v, 1, CONTAINERS)),
    "q18": dict(quantity=lambda v: v == 300 or 312 <= v <= 315),
    "q19": dict(
        brands=lambda v: len(v) == 3 and all(b in BRANDS for b in v),
        quantities=lambda v: 1 <= v[0] <= 10 <= v[1] <= 20 <= v[2] <= 30,
    ),
    "q20": dict(color=_word, start=_year_start, nation=NATION_REGION.__contains__),
    "q21": dict(nation=NATION_REGION.__contains__),
    "q22": dict(
        codes=lambda v: _distinct(v, 7, [str(c) for c in range(10, 35)]),
        orders_since=lambda v: v is None,
    ),
}


def _type(value: str, words: int) -> bool:
    parts = value.split(" ")
    return len(parts) == words and all(p in d for p, d in zip(parts, (TYPE_1, TYPE_2, TYPE_3)))


def check(query: str, values: dict) -> None:
    """Raise ValueError where a value lies outside the standard domain."""
    bad = [k for k, test in DOMAINS[query].items() if not test(values[k])]
    if query == "q07" and values["nation_1"] == values["nation_2"]:
        bad.append("nation_2")
    if query == "q08" and NATION_REGION.get(values["nation"]) != values["region"]:
        bad.append("region")
    if query == "q12" and values["mode_1"] == values["mode_2"]:
        bad.append("mode_2")
    if bad:
        raise ValueError(f"{query}: outside the domain: {', '.join(bad)}")


def params(query: str, profile: str = "standard", **overrides) -> SimpleNamespace:
    """The parameters of one query; standard ones are checked against their domains."""
    values = PROFILES[profile][query] | overrides
    unknown = set(values) - set(PROFILES[profile][query])
    if unknown:
        raise ValueError(f"{query}: unknown parameters: {', '.join(sorted(unknown))}")
    if profile == "standard":
        check(query, values)
    return SimpleNamespace(**values)


def plus_months(day: date, months: int) -> date:
    month = day.month - 1 + months
    return date(day.year + month // 12, month % 12 + 1, day.day)
