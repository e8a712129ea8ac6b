"""Units, standards and technical terms in names: ordered rewriting of a text, and the parameters that each stage finds.

Every stage is one or a few regular expressions over the whole column. What a stage has written must not be read by a later one, so
it is closed in a pair of private-use signs, its digits among them, and opened again at the end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dictionaries as D

N = r"([0-9]+(?:[.,][0-9]+)?)"
AFTER = r"(?![\p{L}\p{N}_])"
BEFORE = r"(?<![\p{L}\p{N}_])"
#: Units that are one token, of pressure, of volume, of ranges, and those that follow a number.
COMPOUND = "м³/ч|м3/ч|об/мин|л/мин|км/ч|м/с|кг/м³|кг/м3|Вт/м²|Вт/м2|м³/с|м3/с|л/с|об/с|кг/ч|т/ч"
PRESSURE = "атм|бар|торр|psi"
VOLUME = r"л|мл|куб\.?м|м³|см³|мм³"
RANGE_UNITS = "мм|см|м|км|г|кг|т|л|мл|В|А|Вт|кВт|°C|°F|Па|кПа|МПа|бар|атм"
MEASURES = r"мм|см|м|км|дм|мкм|нм|г|кг|т|мг|л|мл|куб\.?м|м3|см3|мм3|В|А|Вт|кВт|МВт|Гц|кГц|МГц|ГГц|°C|°F|К|Па|кПа|МПа|ГПа|бар|атм|об/мин|м/с|км/ч|шт|упак|компл|набор"
#: Steel and alloy grades, which are no numbers with units.
GRADES = (r"[0-9]{2}[А-Я]+[0-9]+[А-Я0-9]*(?:-[0-9]+)?", r"[0-9]{2}[А-Я]{2,}", r"[СУ]т?[0-9]+[а-я]*", r"[АВДЛ][А-Я]*[0-9]+[А-Я]*(?:-[0-9]+)?")
STANDARD_UNIT = {"mm": "мм", "cm": "см", "m": "м", "kg": "кг", "g": "г", "l": "л", "v": "В", "в": "В", "вольт": "В", "volt": "В", "a": "А", "а": "А", "ампер": "А", "amp": "А", "w": "Вт", "вт": "Вт", "ватт": "Вт", "watt": "Вт", "c": "°C", "с": "°C", "цельсий": "°C", "celsius": "°C"}
CLOTHING = "костюм|размер|куртка|брюки|полукомбинезон|одежда|рост|обхват|муж|жен"
INCH = 25.4


def found(x: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(x, F.lit(f"(?iu){pattern}"), F.lit(group))


def longest_first(units: str) -> str:
    return "|".join(sorted(units.split("|"), key=len, reverse=True))


def number(x: Column) -> Column:
    return F.replace(x, F.lit(","), F.lit(".")).try_cast("double")


def parameters(x: Column, kind: str, pattern: str, value_group: int = 1, unit_group: int | None = 2, unit: str = "") -> Column:
    """An array of (kind, value, unit, original) for each match."""
    values, units = found(x, pattern, value_group), found(x, pattern, unit_group) if unit_group else None
    zipped = F.arrays_zip(found(x, pattern).alias("o"), values.alias("v"), *([units.alias("u")] if unit_group else []))
    return F.transform(zipped, lambda p: F.struct(F.lit(kind).alias("kind"), number(p["v"]).alias("value"), (F.lower(p["u"]) if unit_group else F.lit(unit)).alias("unit"), p["o"].alias("original")))


def float_text(x: Column, pattern_after: str) -> Column:
    """Numbers before pattern_after as a float is written: a point for the comma, no needless zeros, '.0' where there is no fraction."""
    x = F.regexp_replace(x, rf"(?iu)([0-9]+),([0-9]+)(?=\s*(?:{pattern_after}))", "$1.$2")
    x = F.regexp_replace(x, rf"(?iu)(?<![0-9.])0+(?=[0-9]+(?:\.[0-9]+)?\s*(?:{pattern_after}))", "")
    x = F.regexp_replace(x, rf"(?iu)(\.[0-9]*?[1-9])0+(?=\s*(?:{pattern_after}))", "$1")
    x = F.regexp_replace(x, rf"(?iu)(\.)0+(?=\s*(?:{pattern_after}))", "$10")
    return F.regexp_replace(x, rf"(?iu)(?<![0-9.])([0-9]+)(?=\s*(?:{pattern_after}))", "$1.0")


#: Digits of closed tokens: ten private-use signs from this one; the opening and closing signs follow.
HIDDEN = 0xE000
OPEN, CLOSE = chr(HIDDEN + 10), chr(HIDDEN + 11)


def closed(x: Column, pattern: str, by: str) -> Column:
    """Matches replaced by `by`, marked; hide() then takes them out of later stages' sight."""
    return F.regexp_replace(x, pattern, f"{OPEN}{by}{CLOSE}")


def hide(x: Column) -> Column:
    """Digits inside marks as private signs, so that no later pattern of numbers finds them."""
    inside = F.split(x, f"(?<={CLOSE})|(?={OPEN})")
    return F.array_join(F.transform(inside, lambda p: F.when(F.startswith(p, F.lit(OPEN)), F.translate(p, "0123456789", "".join(chr(HIDDEN + k) for k in range(10)))).otherwise(p)), "")


def lower_ranges(x: Column) -> Column:
    """Marked ranges in lower case, as their units are written so."""
    return F.array_join(F.transform(F.split(x, f"(?<={CLOSE})|(?={OPEN})"), lambda p: F.when(F.startswith(p, F.lit(f"{OPEN}range_")), F.lower(p)).otherwise(p)), "")


def opened(x: Column) -> Column:
    return F.translate(x, "".join(chr(HIDDEN + k) for k in range(12)), "0123456789")


def units_processed(df: DataFrame, text_col: str) -> DataFrame:
    """df with processed, the text after all stages, and parameters, an array of (kind, value, unit, original) in the stages' order.

    Compound units, pressure, volume and coefficients come first; then grades are set aside; fractions, ratios, ranges, inches, dimensions and
    numbers with units follow. A fraction of two numbers from 150 to 200, at most 20 apart, in a text with a word of clothing is a size."""
    x = F.coalesce(F.col(text_col), F.lit(""))
    out: list[Column] = []
    compound, pressure, volume = (f"(?:{longest_first(u)})" for u in (COMPOUND, PRESSURE, VOLUME))
    steps = df.withColumn("_t", x)

    def stage(change, params: Column | None) -> None:
        nonlocal steps
        k = len(out)
        steps = steps.withColumn(f"_p{k}", params)
        out.append(F.col(f"_p{k}"))
        steps = steps.withColumn("_t", change(F.col("_t")))

    t = F.col("_t")
    after = AFTER
    stage(lambda c: hide(closed(float_text(c, compound), rf"(?iu)([0-9]+\.[0-9]+)\s*({compound})", "$1$2")), parameters(t, "составная_единица", rf"{N}\s*({compound})"))
    stage(lambda c: hide(closed(F.regexp_replace(float_text(c, f"{pressure}{after}"), rf"(?iu)([0-9]+\.[0-9]+)\s*(бар|торр|psi){after}", "$1 $2"), rf"(?iu)([0-9]+\.[0-9]+)\s*(атм){after}", "$1$2")), parameters(t, "давление", rf"{N}\s*({pressure}){after}"))
    stage(lambda c: F.regexp_replace(float_text(c, f"{volume}{after}"), rf"(?iu)([0-9]+\.[0-9]+)\s*({volume}){after}", "$1$2"), parameters(t, "объем", rf"{N}\s*({volume}){after}"))
    stage(lambda c: F.regexp_replace(c, rf"(?iu)(?:коэффициент|к-т)\s+{N}", "коэффициент $1"), parameters(t, "коэффициент", rf"(?:коэффициент|к-т)\s+{N}", 1, None, "безразмерный"))
    for g in GRADES:
        steps = steps.withColumn("_t", hide(closed(F.col("_t"), rf"(?u){BEFORE}({g}){AFTER}", "$1")))
    size = rf"{BEFORE}(1[5-9][0-9]|200)/(1[5-9][0-9]|200){AFTER}"
    near = F.abs(F.regexp_extract("_t", size, 1).try_cast("int") - F.regexp_extract("_t", size, 2).try_cast("int")) <= 20
    clothes = F.coalesce(near, F.lit(False)) & F.lower("_t").rlike(CLOTHING)
    steps = steps.withColumn("_t", F.when(clothes, hide(closed(F.col("_t"), size, "size_$1-$2"))).otherwise(F.col("_t")))
    plain = rf'{BEFORE}([0-9]+)/([0-9]+){AFTER}(?!\s*(?:"|дюйм|inch))(?<![0-9]-[0-9]{{1,4}}/[0-9]{{1,4}})'
    fraction = F.transform(F.arrays_zip(found(t, plain).alias("o"), found(t, plain, 1).alias("a"), found(t, plain, 2).alias("b")), lambda p: F.struct(F.lit("дробь").alias("kind"), (number(p["a"]) / F.nullif(number(p["b"]), F.lit(0.0))).alias("value"), F.lit("").alias("unit"), p["o"].alias("original")))
    stage(lambda c: hide(closed(c, rf"(?iu){plain}", "frac_$1-$2")), fraction)
    ratio = rf"{BEFORE}{N}\s*:\s*{N}{AFTER}"
    ratios = F.transform(F.arrays_zip(found(t, ratio).alias("o"), found(t, ratio, 1).alias("a"), found(t, ratio, 2).alias("b")), lambda p: F.struct(F.lit("соотношение").alias("kind"), (number(p["a"]) / F.nullif(number(p["b"]), F.lit(0.0))).alias("value"), F.lit("").alias("unit"), p["o"].alias("original")))
    stage(lambda c: hide(closed(F.regexp_replace(c, r"([0-9]),([0-9]+\s*:)|(:\s*[0-9]+),([0-9])", "$1$3.$2$4"), rf"(?iu){ratio}", "ratio_$1-$2")), ratios)
    ranged = rf"{N}\s*[-–—]\s*{N}\s*({longest_first(RANGE_UNITS)}){after}"
    stage(lambda c: hide(lower_ranges(F.regexp_replace(closed(F.regexp_replace(c, rf"(?iu)([0-9]),([0-9]+)(?=\s*(?:[-–—]|{longest_first(RANGE_UNITS)}))", "$1.$2"), rf"(?iu){ranged}", "range_$1-$2-$3"), "(?iu)(range_[0-9.]+-[0-9.]+-)°", "$1"))), parameters(t, "диапазон", ranged, 1, 3))
    mixed = r'([0-9]+)-([0-9]+)/([1-9][0-9]*)\s*(?:"|дюйм|inch)'
    inches = F.transform(F.arrays_zip(found(t, mixed).alias("o"), found(t, mixed, 1).alias("a"), found(t, mixed, 2).alias("b"), found(t, mixed, 3).alias("c")), lambda p: F.struct(F.lit("размер").alias("kind"), (number(p["a"]) + number(p["b"]) / number(p["c"])).alias("value"), F.lit("дюйм").alias("unit"), p["o"].alias("original")))
    stage(lambda c: hide(closed(c, rf"(?iu){mixed}", "$1-$2/$3 дюйм")), inches)
    inch = rf'{N}\s*(?:"|дюйм|inch)'
    stage(lambda c: hide(closed(F.regexp_replace(c, r'([0-9]),([0-9]+\s*(?:"|дюйм|inch))', "$1.$2"), rf"(?iu){inch}", "$1 дюйм")), parameters(t, "размер", inch, 1, None, "дюйм"))
    dims = rf"{N}\s*[хx×]\s*{N}(?:\s*[хx×]\s*{N})?\s*(мм|см|м|дюйм)?"
    x_after = r"\s*[хx×]|\s*(?:мм|см|м|дюйм)?(?:[^\p{L}\p{N}_.,]|[.,](?![0-9])|$)"
    size3 = lambda c: float_text(c, x_after)
    has_dims = F.col("_t").rlike(rf"(?iu){dims}")
    written = F.regexp_replace(F.regexp_replace(size3(F.col("_t")), rf"(?iu){N}\s*[хx×]\s*{N}\s*[хx×]\s*{N}\s*(мм|см|м|дюйм)?{after}", f'{OPEN}dims=[$1,$2,$3] unit="$4"{CLOSE}'), rf"(?iu){N}\s*[хx×]\s*{N}\s*(мм|см|м|дюйм)?{after}", f'{OPEN}dims=[$1,$2] unit="$3"{CLOSE}')
    stage(lambda c: F.when(has_dims, hide(F.regexp_replace(written, 'unit=""', 'unit="мм"'))).otherwise(c), parameters(t, "размеры", dims, 1, 4))
    units = longest_first(MEASURES)
    stage(lambda c: F.regexp_replace(float_text(c, f"(?:{units}){after}"), rf"(?iu)([0-9]+\.[0-9]+)\s*({units}){after}", "$1 $2"), parameters(t, "измерение", rf"{N}\s*({units}){after}"))
    standard = F.create_map(*[F.lit(v) for kv in STANDARD_UNIT.items() for v in kv])
    every = F.transform(F.flatten(F.array(*out)), lambda p: p.withField("unit", F.coalesce(F.element_at(standard, p["unit"]), p["unit"])).withField("original", opened(p["original"])))
    return steps.withColumn("parameters", every).withColumn("processed", F.trim(opened(F.col("_t")))).drop("_t", *(f"_p{k}" for k in range(len(out))))


#: Fixed values: (kind, pattern): standards, sizes, power, then serial numbers and drawings.
CODES = (
    ("стандарт", rf"{BEFORE}(ГОСТ|ТУ|ОСТ|СТО|СТП|DIN|ISO|EN|ANSI|ASTM|IEC)\s+([0-9А-Яа-яA-Za-z\-./]+)"),
    ("размерный_код", rf"{BEFORE}(DN|PN|M|G|R|Ø)\s*([0-9]+(?:[.,][0-9]+)?)"),
    ("мощностной_код", rf"{N}\s*(кВт|МВт|об/мин|л\.с\.|HP|rpm)"),
    ("серийный_номер", r"(S/?N|серийный\s*номер|сер\.?\s*№?)\s*[:=]?\s*([A-Za-z0-9\-]*[0-9][A-Za-z0-9\-]*)"),
    ("чертеж", rf"{BEFORE}(Ч|DWG)[-\s]*([0-9]+(?:[-.\s][0-9]+)*)"),
)
DESCRIPTIVE = "резиновый|металлический|стальной|пластиковый|круглый|квадратный|эластичный|жесткий"
TECHNICAL = rf"{BEFORE}([0-9]+(?:[.,][0-9]+)?)\s*(мм|см|м|кг|т|л|В|А|Вт|°C|°F|бар|атм|Па|кПа|МПа){AFTER}"


def tech_codes(df: DataFrame, text_col: str) -> DataFrame:
    """df with codes, an array of (kind, code): standards with the type in capitals and without a last hyphen (ОСТ is ГОСТ in a text that
    names a ГОСТ), sizes such as DN50, power, serial numbers and drawings, and numbers with units where no descriptive word is near."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    parts = []
    for kind, p in CODES:
        pairs = F.arrays_zip(found(t, p, 1).alias("a"), found(t, p, 2).alias("b"))
        if kind == "стандарт":
            parts.append(F.transform(pairs, _standard(kind, F.contains(F.upper(t), F.lit("ГОСТ")))))
        elif kind == "мощностной_код":
            parts.append(F.transform(pairs, _joined(kind, comma=True)))
        else:
            parts.append(F.transform(pairs, _joined(kind, upper=kind == "размерный_код", sep=" " if kind == "серийный_номер" else "-" if kind == "чертеж" else "")))
    # a descriptive word within 20 signs of the match, as the match's first place in the text tells
    whole = F.arrays_zip(found(t, TECHNICAL).alias("o"), found(t, TECHNICAL, 1).alias("a"), found(t, TECHNICAL, 2).alias("b"))
    around = lambda p: F.lower(F.substring(t, F.greatest(F.lit(1), F.instr(t, p["o"]) - 20), F.length(p["o"]) + 20 + F.least(F.lit(20), F.greatest(F.lit(0), F.instr(t, p["o"]) - 1))))
    technical = F.transform(F.filter(whole, lambda p: ~around(p).rlike(DESCRIPTIVE)), lambda p: F.struct(F.lit("технический_параметр").alias("kind"), F.concat(F.replace(p["a"], F.lit(","), F.lit(".")), p["b"]).alias("code")))
    return df.withColumn("codes", F.flatten(F.array(*parts, technical)))


def _standard(kind: str, gost: Column):
    def make(p):
        name = F.when((F.upper(p["a"]) == "ОСТ") & gost, "ГОСТ").otherwise(F.upper(p["a"]))
        return F.struct(F.lit(kind).alias("kind"), F.regexp_replace(F.concat(name, F.lit(" "), p["b"]), r"-+$", "").alias("code"))

    return make


def _joined(kind: str, upper: bool = False, comma: bool = False, sep: str = ""):
    def make(p):
        a = F.upper(p["a"]) if upper else p["a"]
        a = F.replace(a, F.lit(","), F.lit(".")) if comma else a
        return F.struct(F.lit(kind).alias("kind"), F.concat(a, F.lit(sep), p["b"]).alias("code"))

    return make


#: Forms of technical terms -> their base.
TERMS = {v: k for k, vs in D.TERM_FORMS.items() for v in vs}


def technical_terms(df: DataFrame, text_col: str) -> DataFrame:
    """df with normalized, compound terms first, then simple ones, then abbreviations in full; terms, what was found and changed ('form -> base'), and has_terms."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    # what stands in marks is out of sight of later tables: no closing sign may follow before an opening one
    seen = f"(?![^{OPEN}]*{CLOSE})"
    one_of = lambda words: rf"{BEFORE}({'|'.join(sorted(words, key=lambda w: (-len(w), w)))}){AFTER}{seen}"
    listed = []
    for table in (D.COMPOUND_TERMS, TERMS, D.TERM_ABBREVIATIONS):
        hits = found(t, one_of(table), 1)
        bases = F.create_map(*[F.lit(v) for kv in table.items() for v in kv])
        arrows = F.transform(hits, _arrow(bases))
        unlike = lambda a: F.split_part(a, F.lit(" -> "), F.lit(1)) != F.split_part(a, F.lit(" -> "), F.lit(2))
        listed.append(arrows if table is D.COMPOUND_TERMS else F.filter(arrows, unlike))
        for base in dict.fromkeys(table.values()):
            forms = [k for k, v in table.items() if v == base]
            t = closed(t, rf"(?iu){one_of(forms)}", base)
        t = hide(t)
    text = F.trim(opened(t))
    terms = F.flatten(F.array(*listed))
    return df.withColumn("terms", terms).withColumn("has_terms", F.size("terms") > 0).withColumn("normalized", text)


def _arrow(bases: Column):
    return lambda w: F.concat(w, F.lit(" -> "), F.element_at(bases, F.lower(w)))
