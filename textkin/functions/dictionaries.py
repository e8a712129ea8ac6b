"""Dictionaries of the catalog domain, as data. Fixed values, except where a table is built by a rule."""

from __future__ import annotations

PROTECTED = ("ГОСТ", "ТУ", "ОСТ", "СТО", "DIN", "ISO", "DN", "PN", "RPM", "°C", "°F", "м³/ч", "об/мин", "кВт", "МВт", "кПа", "МПа")

#: symbol -> (nominative singular, genitive singular, genitive plural)
UNIT_NAMES = {
    "мм": ("миллиметр", "миллиметра", "миллиметров"),
    "см": ("сантиметр", "сантиметра", "сантиметров"),
    "м": ("метр", "метра", "метров"),
    "км": ("километр", "километра", "километров"),
    "г": ("грамм", "грамма", "граммов"),
    "кг": ("килограмм", "килограмма", "килограммов"),
    "т": ("тонна", "тонны", "тонн"),
    "л": ("литр", "литра", "литров"),
    "мл": ("миллилитр", "миллилитра", "миллилитров"),
    "В": ("вольт", "вольта", "вольтов"),
    "А": ("ампер", "ампера", "амперов"),
    "Вт": ("ватт", "ватта", "ваттов"),
    "кВт": ("киловатт", "киловатта", "киловаттов"),
    "Па": ("паскаль", "паскаля", "паскалей"),
    "кПа": ("килопаскаль", "килопаскаля", "килопаскалей"),
    "МПа": ("мегапаскаль", "мегапаскаля", "мегапаскалей"),
    "атм": ("атмосфера", "атмосферы", "атмосфер"),
}
ABBREVIATIONS = {
    "электрический": ("эл", "электр"),
    "механический": ("мех", "механ"),
    "гидравлический": ("гидр", "гидравл"),
    "пневматический": ("пневм", "пневмат"),
    "автоматический": ("автом", "авт"),
    "ручной": ("ручн", "руч"),
    "стандартный": ("стандарт", "станд"),
    "специальный": ("спец", "специал"),
}
SYNONYMS = {
    "резиновый": ("каучуковый", "эластичный", "гуммированный", "латексный"),
    "стальной": ("металлический", "железный", "из стали"),
    "пластиковый": ("пластмассовый", "полимерный", "из пластика"),
    "алюминиевый": ("алюминевый", "из алюминия", "дюралевый"),
    "медный": ("из меди", "бронзовый", "латунный"),
    "керамический": ("керамичный", "из керамики", "фарфоровый"),
    "стеклянный": ("из стекла", "стекло"),
    "деревянный": ("из дерева", "древесный"),
    "бумажный": ("из бумаги", "картонный"),
    "тканевый": ("текстильный", "из ткани", "матерчатый"),
    "цилиндрический": ("круглый", "трубчатый", "цилиндровый"),
    "прямоугольный": ("четырехугольный", "квадратный"),
    "сферический": ("шарообразный", "круглый", "шаровой"),
    "конический": ("конусный", "конусообразный"),
    "плоский": ("плоскостной", "ровный"),
    "изогнутый": ("кривой", "гнутый", "согнутый"),
    "спиральный": ("винтовой", "закрученный", "витой"),
    "запорный": ("перекрывающий", "отсекающий", "блокирующий"),
    "регулирующий": ("настроечный", "управляющий", "контрольный"),
    "фильтрующий": ("очищающий", "фильтровальный"),
    "соединительный": ("соединяющий", "крепежный", "стыковочный"),
    "уплотнительный": ("герметизирующий", "изолирующий"),
    "защитный": ("предохранительный", "охранный", "безопасности"),
    "измерительный": ("контрольный", "мерительный", "датчиковый"),
    "приводной": ("движущий", "передаточный", "силовой"),
    "подшипник": ("подшипниковый узел", "опора"),
    "втулка": ("гильза", "вкладыш", "муфта"),
    "прокладка": ("уплотнение", "сальник", "манжета"),
    "фильтр": ("фильтрующий элемент", "очиститель"),
    "клапан": ("вентиль", "затвор", "заслонка"),
    "насос": ("помпа", "нагнетатель"),
    "двигатель": ("мотор", "привод", "движок"),
    "редуктор": ("понижающий редуктор", "замедлитель"),
    "муфта": ("соединение", "сцепление", "переходник"),
    "большой": ("крупный", "увеличенный", "габаритный"),
    "малый": ("маленький", "мини", "компактный", "миниатюрный"),
    "тонкий": ("узкий", "тонкостенный"),
    "толстый": ("широкий", "толстостенный"),
    "длинный": ("удлиненный", "протяженный"),
    "короткий": ("укороченный", "компактный"),
    "легкий": ("облегченный", "малый по весу"),
    "тяжелый": ("усиленный", "массивный"),
}
#: canonical term -> variants; the first canonical that names a variant takes it.
TERM_VARIANTS = {
    "болт": ("болт", "винт крепежный", "крепежный болт"),
    "гайка": ("гайка", "гайка крепежная"),
    "шайба": ("шайба", "шайба плоская", "шайба круглая"),
    "винт": ("винт", "винт крепежный", "крепежный винт"),
    "труба": ("труба", "трубка", "трубопровод"),
    "фитинг": ("фитинг", "соединение", "переходник"),
    "муфта": ("муфта", "муфта соединительная"),
    "кабель": ("кабель", "провод", "проводник"),
    "разъем": ("разъем", "соединитель", "коннектор"),
    "выключатель": ("выключатель", "переключатель"),
}
#: technical terms: base form -> forms
TERM_FORMS = {
    "штрихкод": ("штрихкодирования", "штрихкод", "штрих", "штрикод"),
    "штуцер": ("штуцеру", "штуцером", "штуцеров", "штуцерных", "штуцерный", "штуцерная", "штуцерами", "штуцера", "штуцер", "штуц"),
    "чугун": ("чугуну", "чугунными", "чугунным", "чугунный", "чугунные", "чугунная", "чугуна", "чугун", "чуг"),
}
COMPOUND_TERMS = {"штуцер-штуцер": "штуцер-штуцер", "штуцер-елочка": "штуцер-елочка", "штуцер-гайка": "штуцер-гайка", "штуцерно-торцовый": "штуцер-торцовый", "штуцерно-торцевое": "штуцер-торцовый", "штрих-код": "штрихкод", "штрих-кода": "штрихкод"}
TERM_ABBREVIATIONS = {"шт": "штука", "кг": "килограмм", "мм": "миллиметр", "см": "сантиметр", "м": "метр", "л": "литр", "мл": "миллилитр", "в": "вольт", "вт": "ватт", "а": "ампер", "гц": "герц", "бар": "бар", "атм": "атмосфера"}
#: Colour adjectives by stem and the endings in use, then single words.
COLOUR_PARADIGMS = (
    (("красн", "зелен", "желт", "черн", "бел", "сер"), ("ый", "ая", "ое", "ые", "ого", "ой", "ым", "ыми")),
    (("чёрн", "оранжев", "фиолетов", "розов", "коричнев", "бежев", "кремов", "бронзов", "малинов", "вишнев", "лимонн", "салатов", "мятн", "бирюзов", "изумрудн", "сиренев", "лилов", "бордов"), ("ый", "ая", "ое", "ые")),
    (("серебрян", "прозрачн", "матов", "глянцев", "перламутров", "хромированн", "латунн", "медн", "алюминиев", "цветн", "разноцветн", "многоцветн", "однотонн", "двухцветн", "трехцветн"), ("ый", "ая", "ое", "ые")),
    (("син",), ("ий", "яя", "ее", "ие", "его", "ей", "им", "ими", "ь")),
    (("голуб", "золот"), ("ой", "ая", "ое", "ые")),
    (("металлическ",), ("ий", "ая", "ое", "ие")),
    (("золотист", "серебрист", "терракотов", "песочн", "слонов", "никелированн"), ("ый", "ая")),
    (("костян",), ("ой", "ая")),
)
COLOUR_WORDS = (*(stem + end for stems, ends in COLOUR_PARADIGMS for stem in stems for end in ends), "марсала", "хаки", "кость", "металлик", "хром", "никель", "латунь", "медь", "алюминий", "цвет")
#: Words that change a colour's shade: adverbs, then adjectives by stem and ending.
COLOUR_MODIFIERS = (
    *("ярко", "темно", "светло", "бледно", "насыщенно", "глубоко", "нежно", "мягко", "интенсивно", "приглушенно", "тускло", "слабо", "сильно", "густо", "ярче", "темнее", "светлее"),
    *(stem + end for stem in ("темн", "светл", "бледн", "насыщенн", "нежн", "интенсивн", "приглушенн", "тускл", "слаб", "сильн", "густ") for end in ("ый", "ая", "ое", "ые")),
    *(stem + end for stem in ("ярк", "глубок", "мягк") for end in ("ий", "ая", "ое", "ие")),
    "густой", "сильный",
)

FUNCTIONAL_GROUPS = {
    "грузоподъемные": ("кран", "подъемник", "тельфер", "лебедка"),
    "транспортные": ("тягач", "трал", "автомобиль", "грузовик"),
    "электротехнические": ("автомат", "выключатель", "розетка", "кабель"),
    "инструментальные": ("отвертка", "ключ", "дрель", "шуруповерт"),
    "химические": ("краска", "растворитель", "клей", "герметик"),
    "металлические": ("болт", "гайка", "шайба", "швеллер", "уголок"),
    "осветительные": ("лампа", "светильник", "фонарь", "прожектор"),
}
OTHER_GROUP = "прочие"
#: The nine semantic classes, first hit wins; words are matched anywhere in the text.
SEMANTIC_CLASSES = {
    "automotive": ("автомобиль", "машина", "двигатель", "колесо", "фара", "лампа", "масло"),
    "electronics": ("электрон", "провод", "кабель", "розетка", "выключатель", "лампочка"),
    "construction": ("строительн", "цемент", "кирпич", "плитка", "краска", "клей"),
    "industrial": ("промышленн", "станок", "инструмент", "подшипник", "болт", "гайка"),
    "chemical": ("химическ", "кислота", "щелочь", "растворитель", "реагент"),
    "textile": ("ткань", "нить", "волокно", "пряжа", "текстиль"),
    "food": ("пищев", "продукт", "консерв", "напиток", "мука", "сахар"),
    "medical": ("медицинск", "лекарств", "препарат", "бинт", "шприц"),
}
CATEGORY_BASE = {
    "средства_защиты": ("ледоход", "ледоходы", "шипы", "антискольжение", "противоскользящие", "каска", "шлем", "очки", "перчатки", "респиратор", "маска", "жилет", "костюм", "комбинезон", "сапоги", "ботинки", "защитные", "профессиональный", "рабочий", "защита", "безопасность"),
    "крепеж": ("болт", "гайка", "шуруп", "саморез", "винт", "заклепка", "дюбель", "анкер", "шпилька", "шайба", "гровер", "скоба", "крепежный", "метизы", "резьбовой", "оцинкованный"),
    "электрика": ("кабель", "провод", "розетка", "выключатель", "лампа", "светильник", "трансформатор", "автомат", "предохранитель", "реле", "контактор", "щит", "короб", "гофра", "изолятор", "электрический", "электротехнический"),
    "сантехника": ("труба", "фитинг", "кран", "вентиль", "задвижка", "клапан", "насос", "фильтр", "бойлер", "радиатор", "батарея", "унитаз", "раковина", "ванна", "душ", "смеситель", "сантехнический", "водопроводный"),
    "инструменты": ("отвертка", "ключ", "молоток", "пила", "дрель", "шуруповерт", "болгарка", "перфоратор", "лобзик", "рубанок", "стамеска", "плоскогубцы", "кусачки", "тиски", "струбцина", "инструмент", "набор"),
    "металлопрокат": ("швеллер", "балка", "уголок", "профиль", "труба", "лист", "полоса", "круг", "квадрат", "арматура", "сетка", "проволока", "металлический", "стальной", "железный", "алюминиевый"),
    "химия": ("растворитель", "сольвент", "ацетон", "спирт", "кислота", "щелочь", "реагент", "присадка", "антифриз", "масло", "смазка", "очиститель", "обезжириватель", "химический", "краска"),
    "текстиль": ("ткань", "полотно", "брезент", "тент", "полог", "пленка", "мешок", "рукав", "лента", "веревка", "канат", "трос", "текстильный", "хлопчатобумажный", "синтетический"),
}
#: Further forms that the catalog's own configuration adds.
CATEGORY_FORMS = {
    "средства_защиты": "ледоход ледоходы ледоходов ледоходами каска каски касок касками перчатки перчаток перчатками респиратор респираторы респираторов очки защитные защитных защитными жилет жилеты жилетов жилетами сигнальный сигнальные сигнальных проф профессиональный профессиональные профессиональных шипы шипов шипами шип белая белый белые белых оранжевый оранжевые оранжевых прозрачные прозрачных прозрачными хлопок хлопковые хлопчатобумажные противопылевой противопылевые".split(),
    "химия": "сольвент сольвенты сольвентов растворитель растворители растворителей краска краски красок красками ацетон ацетона ацетоном спирт спирта спиртом кислота кислоты кислот кислотами водоэмульсионная водоэмульсионные этиловый этиловые этилового серная серные серной технический техническая технические универсальный универсальные универсального литров литры литр".split(),
    "металлопрокат": "швеллер швеллеры швеллеров уголок уголки уголков уголками лист листы листов листами арматура арматуры арматурой проволока проволоки проволокой сетка сетки сеток сетками стальной стальные стальных стальными горячекатаный горячекатаные горячекатаных сварная сварные сварных сварными мм миллиметр миллиметры миллиметров".split(),
    "крепеж": "болт болты болтов болтами гайка гайки гаек гайками винт винты винтов винтами шуруп шурупы шурупов шурупами заклепка заклепки заклепок заклепками дюбель дюбели дюбелей дюбелями оцинкованный оцинкованные оцинкованных шестигранная шестигранные шестигранных самонарезающий самонарезающие самонарезающих алюминиевая алюминиевые алюминиевых пластиковый пластиковые пластиковых дереву дерева деревом".split(),
    "текстиль": "полог пологи пологов пологами тент тенты тентов тентами ткань ткани тканей тканями брезент брезенты брезентов брезентами мешок мешки мешков мешками брезентовый брезентовые брезентовых защитный защитные защитных защитными хлопчатобумажная хлопчатобумажные хлопчатобумажных водостойкий водостойкие водостойких полипропиленовый полипропиленовые полипропиленовых".split(),
}
CATEGORY_KEYWORDS = {k: tuple(dict.fromkeys((*v, *CATEGORY_FORMS.get(k, ())))) for k, v in CATEGORY_BASE.items()}
#: Patterns of lower-case text that speak for a category.
CATEGORY_PATTERNS = {
    "средства_защиты": (r"ледоход[\p{L}\p{N}_]*\s+проф", r"ледоход[\p{L}\p{N}_]*\s+[0-9]+", r"шип[\p{L}\p{N}_]*\s+[0-9]+"),
    "металлопрокат": (r"швеллер\s+[0-9]+", r"уголок\s+[0-9]+x[0-9]+", r"лист\s+[0-9]+мм"),
    "химия": (r"сольвент\s+[0-9]+", r"растворитель\s+[0-9]+"),
    "текстиль": (r"полог\s+[0-9]+", r"тент\s+[0-9]+"),
}
#: A smaller number wins a tie; categories without one come last (999).
CATEGORY_PRIORITY = {"средства_защиты": 10, "химия": 9, "металлопрокат": 8, "крепеж": 7, "текстиль": 6}
SIMILAR_CATEGORIES = {
    "электрика": ("освещение", "электротехника", "электрооборудование"),
    "металлопрокат": ("металл", "сталь", "железо"),
    "сантехника": ("водоснабжение", "отопление", "канализация"),
    "инструменты": ("инструмент", "оборудование"),
    "химия": ("химические_вещества", "растворители", "краски"),
    "крепеж": ("метизы", "болты", "гайки", "шайбы"),
    "общие_товары": ("прочее", "разное", "прочие_товары"),
}
KNOWN_BRANDS = (
    "neox osairous yealink sanfor санфор биолан нэфис персил dallas премиум маяк chint andeli grass kraft reoflex керхер huawei honor высота ugreen alisafox маякавто техноавиа восток-сервис attache камаз зубр hp ekf dexp matrix siemens комус gigant hyundai iveco stayer brauberg makita bentec сибртех bosch rexant sampa kyocera avrora derrick cummins economy samsung ofite professional caterpillar intel proxima core shantui king office петролеум трейл skf форвелд скаймастер tony kentek ресанта dexter electric оттм"
).split()
BRAND_GROUPS = {"hp": ("hewlett", "packard"), "samsung": ("samsung", "galaxy"), "huawei": ("huawei", "honor"), "bosch": ("bosch", "blue"), "makita": ("makita", "lxt")}
TECHNICAL_WORDS = ("автомат", "выключатель", "кран", "насос", "двигатель", "трансформатор", "датчик", "контроллер", "адаптер", "аккумулятор")
DEFAULT_CATEGORY = "общие_товары"
STOP_WORDS = ("и", "в", "на", "с", "для", "из", "по", "от", "до", "the", "of", "and", "in", "to", "is", "de", "la", "le", "der", "die", "und", "que", "en")

NUMBER = r"([0-9]+(?:[.,][0-9]+)?)"
END = r"(?:[^\p{L}\p{N}_]|$)"
#: (name, labels or none, units, type, default unit, priority): a labelled or bare number with a unit.
MEASURES = (
    ("diameter", ("диаметр", "диам", "ø"), ("мм", "см", "м"), "dimension", "мм", 3),
    ("length", ("длина", "длин"), ("мм", "см", "м"), "dimension", "мм", 3),
    ("width", ("ширина", "шир"), ("мм", "см", "м"), "dimension", "мм", 3),
    ("height", ("высота", "выс"), ("мм", "см", "м"), "dimension", "мм", 3),
    ("thickness", ("толщина", "толщ"), ("мм", "см", "м"), "dimension", "мм", 3),
    ("dimension_direct", (), ("мм", "см", "м"), "dimension", "мм", 2),
    ("weight", ("вес", "масса"), ("кг", "г", "т"), "weight", "кг", 3),
    ("weight_g", (), ("гр", "г", "g"), "weight", "г", 3),
    ("weight_kg", (), ("кг", "kg"), "weight", "кг", 3),
    ("voltage_explicit", ("напряжение", "напр"), ("вольт", "в", "v"), "voltage", "В", 3),
    ("voltage_direct", (), ("в", "v"), "voltage", "В", 3),
    ("current_explicit", ("ток",), ("ампер", "а", "a"), "current", "А", 3),
    ("current_direct", (), ("а", "a"), "current", "А", 3),
    ("power", (), ("вт", "w"), "electrical", "Вт", 3),
    ("power_kw", (), ("квт", "kw"), "electrical", "кВт", 3),
    ("pressure", ("давление", "давл"), ("кпа", "мпа", "па", "бар", "атм", "kpa", "mpa", "pa", "bar", "atm"), "pressure", "МПа", 3),
    ("frequency_direct", (), ("кгц", "мгц", "ггц", "гц", "khz", "mhz", "ghz", "hz"), "frequency", "Гц", 3),
    ("volume_ml", (), ("мл", "ml"), "volume", "мл", 3),
    ("volume_l", (), ("л", "l"), "volume", "л", 3),
    ("battery_capacity_mah", (), ("мач", "mah"), "capacity", "мАч", 3),
    ("battery_capacity_ah", (), ("ач", "ah"), "capacity", "Ач", 3),
    ("quantity_pieces", (), ("штуки", "штук", "шт"), "quantity", "шт", 3),
    ("quantity_set", (), ("комплект", "компл", "набор"), "quantity", "компл", 3),
)
#: (name, pattern with one group, type, priority): values that aren't a number with a unit.
MARKS = (
    ("ip_rating", r"ip\s*([0-9]{2})", "article", 3),
    ("color_temperature", r"([0-9]{4,5})\s*k(?:[^\p{L}\p{N}_]|$)", "temperature", 3),
    ("steel_grade", r"(?:сталь|марка\s+стали)\s+([а-я0-9\-]{2,10})", "material", 3),
    ("article", r"(?:артикул|арт\.?|код|code)\s*[=:]?\s*([a-z0-9\-_]+)", "article", 3),
    ("gost", r"(гост\s+[0-9]+(?:\.[0-9]+)*(?:-[0-9]+)?)", "article", 3),
    ("model_code", r"(?:модель|model)\s*[=:]?\s*([a-z0-9\-_]+)", "model", 3),
    ("metric_thread", r"м([0-9]+[хx][0-9]+(?:[.,][0-9]+)?)", "thread", 3),
    ("dimensions_3d", r"([0-9]+[хx][0-9]+[хx][0-9]+)", "dimension", 3),
)
#: (name, pattern, type, default unit, priority, groups of the value, group of the unit or 0): forms of several groups. Groups of a value are
#: joined by 'x', by '-' in characteristics. A combined form gives a second parameter, named '..._from_combined'.
FORMS = (
    ("weight_g_compact", NUMBER + "(гр|г)" + END, "weight", "г", 4, (1,), 2),
    ("weight_kg_compact", NUMBER + "(кг|kg)" + END, "weight", "кг", 4, (1,), 2),
    ("temperature", r"(?:температура|темп\.?)\s*[=:]?\s*([+-]?[0-9]{1,3}(?:[.,][0-9]+)?)\s*(°?c|°?f)", "temperature", "°C", 3, (1,), 2),
    ("frequency_explicit", r"(?:частота|част\.?)\s*[=:]?\s*" + NUMBER + r"\s*(гц|hz|кгц|khz|мгц|mhz|ггц|ghz)", "frequency", "Гц", 3, (1,), 2),
    ("material", r"(?:материал|мат\.?)\s*[=:]?\s*([а-яё\s]{3,20})(?:\s|$|,|;)", "material", "", 3, (1,), 0),
    ("material_specific", r"(?:^|,|\s)(медный|стальной|пластиковый|алюминиевый|железный|деревянный|резиновый)(?:,|\s|$)", "material", "", 3, (1,), 0),
    ("color", r"(?:^|,|\s|цвет\s*)(белый|черный|красный|синий|зеленый|желтый|серый|коричневый|серебристый|золотой|прозрачный)(?:,|\s|$)", "color", "", 2, (1,), 0),
    ("battery_capacity_mah_compact", "([0-9]+)(мач|mah)" + END, "capacity", "мАч", 4, (1,), 2),
    ("battery_capacity_mah_brackets", r"\([0-9]*?" + NUMBER + r"(мач|mah)\)", "capacity", "мАч", 4, (1,), 2),
    ("battery_capacity_ah_compact", NUMBER + "(ач|ah)" + END, "capacity", "Ач", 4, (1,), 2),
    ("battery_capacity_wh", NUMBER + r"\s*(втч|wh|вт·ч|w·h)" + END, "capacity", "Втч", 3, (1,), 2),
    ("quantity_package", r"(?:уп\.?|упаковка)\s*([0-9]{1,4})\s*(шт|штук)?", "quantity", "шт", 3, (1,), 2),
    ("dimensions_2d", r"([0-9]+)(?:х|x)([0-9]+)\s*(мм|см|м)?", "dimension", "мм", 2, (1, 2), 3),
    ("breaker_characteristic", r"(?:характеристика|тип)\s*([a-d]|[а-г])" + END, "characteristic", "", 3, (1,), 0),
    ("characteristic_direct", r"(?:^|,|\s)([a-d]|[а-г])(?:,|\s|$)", "characteristic", "", 2, (1,), 0),
    ("breaker_type_direct", r"([0-9]+a?)\s*-\s*([0-9]+)\s*-\s*([a-d]|[а-г])" + END, "characteristic", "", 3, (1, 2, 3), 0),
    ("weight_volume_combined", NUMBER + "(кг|kg)" + NUMBER + "(л|l)" + END, "weight", "", 4, (1,), 2),
    ("volume_from_combined", NUMBER + "(кг|kg)" + NUMBER + "(л|l)" + END, "volume", "", 4, (3,), 4),
    ("power_rpm_combined", NUMBER + "(квт|kw)([0-9]+)(об/?мин|rpm)" + END, "electrical", "", 4, (1,), 2),
    ("rpm_from_combined", NUMBER + "(квт|kw)([0-9]+)(об/?мин|rpm)" + END, "speed", "об/мин", 4, (3,), 0),
    ("current_voltage_combined", NUMBER + "(а|a)" + NUMBER + "(в|v)" + END, "current", "", 4, (1,), 2),
    ("voltage_from_combined", NUMBER + "(а|a)" + NUMBER + "(в|v)" + END, "voltage", "", 4, (3,), 4),
    ("dimensions_compact", r"([0-9]+)х([0-9]+)х?([0-9]+)?\s*(мм|см|м)?" + END, "dimension", "мм", 4, (1, 2, 3), 4),
)
#: What makes a match of a type a false one: patterns of the text within 30 signs of it.
FALSE_CONTEXT = {
    "dimension": r"[0-9]+k(?:[^\p{L}\p{N}_]|$)|ip\s*[0-9]+|[a-z][0-9]+[a-z]",
    "pressure": r"ip\s*[0-9]+",
    "weight": r"артикул|код",
    "frequency": r"[a-z][0-9]+[a-z]|f[0-9]+-[0-9]+|[0-9]+f[0-9]+",
    "voltage": r"elt-[0-9]+|модель|model|артикул|арт\.?|код|code",
    "current": r"elt-[0-9]+|модель|model|артикул|арт\.?|код|code",
    "quantity": r"артикул|арт\.?|код|code|модель|model",
    "material": r"система|system|модель|model",
}
BATTERY = "аккумулятор|батарея|battery|акб|power *bank|ноутбук|laptop|телефон|phone|рация|радиостанция|шуруповерт|matebook|probook|greenworks|makita|li-ion"
#: (type, condition on the number) that makes a match a false one.
FALSE_NUMBER = (("weight", "number > 1000 AND default_unit = 'кг'"), ("frequency", "number < 1 OR number > 100000000000"), ("current", "number > 1000"), ("voltage", "number > 100000"), ("quantity", "number > 10000"))
#: type -> (least, most) of a believable number
REALISTIC = {"voltage": (0.1, 1e5), "current": (1e-3, 1e3), "weight": (1e-3, 1e5), "dimension": (1e-2, 1e5), "electrical": (1e-3, 1e7), "frequency": (1e-2, 1e12), "volume": (1e-3, 1e6)}
#: unit -> (base unit, factor)
UNIT_FACTORS = {"мм": ("м", 0.001), "см": ("м", 0.01), "м": ("м", 1.0), "г": ("кг", 0.001), "кг": ("кг", 1.0), "т": ("кг", 1000.0), "мл": ("л", 0.001), "л": ("л", 1.0), "вт": ("Вт", 1.0), "квт": ("Вт", 1000.0), "в": ("В", 1.0), "а": ("А", 1.0)}


def measure_pattern(labels: tuple[str, ...], units: tuple[str, ...]) -> str:
    """Groups: the number, the unit. Alternatives are longest first, so none hides another."""
    unit = "(" + "|".join(sorted(units, key=lambda u: (-len(u), u))) + ")"
    label = r"(?:" + "|".join(labels) + r")\.?\s*[=:]?\s*" if labels else ""
    return label + NUMBER + r"\s*" + unit + END


#: A catalog of short technical names that the driver's tables lack; it goes with part's names wherever names are read.
NAMES = (
    "Болт М10х50 оцинкованный ГОСТ 7798-70", "Болт м10х50 стальной", "Гайка М10 стальная 100 шт", "Кабель ВВГнг 3х2.5 ГОСТ 31996-2012", "Лампа LED 10 Вт 4000K IP65",
    "Автомат 16 А 220 В", "Насос давление 6 бар 1.5 кВт", "Помпа давление 6 бар 1.5 кВт", "Краска ярко-красная 2 кг", "Краска белая 2.5 кг", "Труба диаметр 50 мм длина 3 м", "Ледоход проф 10",
    "Перчатки резиновые 10 шт", "Швеллер 12 сталь 09г2с", "Масло 5 литров", "Вес 10 килограммов <b>нетто</b>", "Клапан запорный DN50 PN16", "Двигатель эл 380 В 50 Гц", "", "Арт 45-67 __ |||| код A-12",
    "Дрель Makita 18V аккумулятор 2 А", "Дрель Bosch 18V аккумулятор 2 А", "Смартфон Huawei 8 темно-синий", "Смартфон Honor 8 белый", "Автомат выключатель 16 А", "Автомат выключатель 25 А", "Кран 25т", "Кран 40т", "Болт М10х50 ГОСТ 7798-70 Stayer",
    "Вентилятор 1500 об/мин 10 м³/ч", "Кран 1/2\" чугунный штуцер", "Бак 25кг30л", "Автомат тип C 16А220В", "Аккумулятор 2000 мач (2000mah)", "Труба 2,5 дюйм",
)
#: Categories and brands of NAMES, in their order; empty where there is none.
NAME_CATEGORIES = (
    "крепеж", "крепеж", "гайки", "электрика", "освещение", "электрика", "сантехника", "сантехника", "химия", "краски", "сантехника", "средства_защиты", "средства_защиты", "металлопрокат", "химия", "", "сантехника", "электрика", "", "",
    "инструменты", "инструмент", "прочее", "общие_товары", "электрика", "электротехника", "прочее", "прочее", "крепеж",
    "", "", "", "", "", "",
)
NAME_BRANDS = {21: "Makita", 22: "Bosch", 23: "Huawei", 24: "Honor", 29: "Stayer"}
CATALOG = tuple((-i, n, c, NAME_BRANDS.get(i, "")) for i, (n, c) in enumerate(zip(NAMES, NAME_CATEGORIES, strict=True), 1))
#: value -> keywords in their order, found anywhere in the lower-case text.
MATERIAL_WORDS = {
    "металл": ("сталь", "железо", "алюминий", "медь", "латунь", "бронза", "титан", "никель"),
    "пластик": ("пластик", "полиэтилен", "полипропилен", "пвх", "полистирол", "акрил"),
    "дерево": ("дерево", "древесина", "фанера", "дсп", "мдф", "массив"),
    "стекло": ("стекло", "оргстекло", "плексиглас"),
    "резина": ("резина", "каучук", "силикон", "эластомер"),
    "керамика": ("керамика", "фарфор", "фаянс"),
    "композит": ("композит", "карбон", "кевлар", "стекловолокно"),
}
FUNCTION_WORDS = {
    "сварка": ("сварка", "сварочный", "электрод", "припой"),
    "резка": ("резка", "резать", "нож", "лезвие", "диск"),
    "сверление": ("сверление", "сверло", "дрель", "бур"),
    "шлифовка": ("шлифовка", "шлифовать", "наждак", "абразив"),
    "покраска": ("покраска", "краска", "покрытие", "лак"),
    "очистка": ("очистка", "чистка", "моющий", "детергент"),
    "смазка": ("смазка", "смазывать", "масло", "смазочный"),
    "изоляция": ("изоляция", "изолятор", "диэлектрик", "непроводящий"),
    "защита": ("защита", "защитный", "броня", "щит"),
    "крепление": ("крепление", "крепеж", "болт", "гайка", "винт"),
}
