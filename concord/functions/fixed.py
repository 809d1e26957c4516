"""Lookup strings, patterns and thresholds that results depend on."""

# Latin letters and the Cyrillic letters of the same shape, in pairs.
LATIN, CYRILLIC = "aeocpxykmthb", "аеосрхукмтнв"
# Digits and the Cyrillic letters they are misread as, in pairs.
DIGITS, DIGIT_LETTERS = "306", "зоб"
QUOTES = "«»“”\"'‘’"
DASHES = "–—−"

# Groups of characters that are taken for one another in weak print.
CONFUSION = ("оo0", "ий", "дл", "аa", "еe", "сc", "рp")

# White space as the engine understands it: ASCII, no-break space, byte-order mark and all Unicode separators.
WS = r"[\t-\r \x{A0}\x{FEFF}\p{Z}]"

# Unit -> kind, factor to litre or gram, canonical unit.
UNITS = {
    "л": ("volume", 1.0, "л"), "l": ("volume", 1.0, "л"), "литр": ("volume", 1.0, "л"), "литра": ("volume", 1.0, "л"), "литров": ("volume", 1.0, "л"),
    "мл": ("volume", 0.001, "мл"), "ml": ("volume", 0.001, "мл"), "cl": ("volume", 0.01, "сл"), "сл": ("volume", 0.01, "сл"),
    "дм3": ("volume", 1.0, "дм³"), "dm3": ("volume", 1.0, "дм³"), "м3": ("volume", 1000.0, "м³"), "m3": ("volume", 1000.0, "м³"),
    "г": ("mass", 1.0, "г"), "g": ("mass", 1.0, "г"), "кг": ("mass", 1000.0, "кг"), "kg": ("mass", 1000.0, "кг"), "мг": ("mass", 0.001, "мг"), "mg": ("mass", 0.001, "мг"),
}
UNIT_ORDER = "литров литра литр дм3 dm3 м3 m3 мл ml cl сл кг kg мг mg л l г g".split()
QUANTITY_TITLE = r"(?iu)^(?:об[ъь]?[её]м|масса(?: нетто)?|количество(?: товара)?|номинальный об[ъь]?[её]м)$"

# Other spellings of one unit: pattern after a digit or slash, what stands instead, from, to.
NOTATIONS = [
    (r"(?iu)(?<=[\d/])(\s*)дм\s*[3³]", "л", "дм³", "л"),
    (r"(?iu)(?<=[\d/])(\s*)л(?![\p{L}\p{N}])", "дм3", "л", "дм³"),
    (r"(?iu)(?<=[\d/])(\s*)см\s*[3³]", "мл", "см³", "мл"),
    (r"(?iu)(?<=[\d/])(\s*)мл(?![\p{L}\p{N}])", "см3", "мл", "см³"),
]

# Reading confidence of the second engine on the first one's scale: corner points.
CALIBRATION = [(0.0, 0.0), (62.0, 40.0), (85.0, 62.0), (92.5, 72.0), (97.0, 85.0), (99.5, 97.0), (100.0, 99.0)]

# Confidence floors, 0..100.
FLOOR_CONSENSUS, FLOOR_BLANK, FLOOR_USABLE, FLOOR_SURE, FLOOR_NUMBER, FLOOR_SINGLE = 20, 30, 75, 80, 85, 90

# EAN-13: bits of the left odd digits 0..9, and which of the six left digits are even for each first digit.
EAN_LEFT = "0001101 0011001 0010011 0111101 0100011 0110001 0101111 0111011 0110111 0001011".split()
EAN_PARITY = "LLLLLL LLGLGG LLGGLG LLGGGL LGLLGG LGGLLG LGGGLL LGLGLG LGLGGL LGGLGL".split()

# Heads of table columns and of marked paragraphs.
TITLE_HEAD = r"раздел|показатель|элемент|наименование информации"
TEXT_HEAD, NOT_TEXT_HEAD = r"текст|формулировк|^надпись$", r"размер.*надписи"
CONSTRAINT_HEAD = r"требован|размер|услови|высот|ограничен"
SIZE_LITERAL = r"(?iu)\d\s*(?:мм|см|%)"
TEXT_MARK = r"(?iu)^(?:текст(?:\s+(?:этикетки|для (?:размещения|нанесения)(?: на этикетке)?|на этикетке))?|надпись|формулировка)\s*:\s*(.*)$"
CONSTRAINT_MARK = r"(?iu)^(?:требования(?: к (?:размерам|маркировке))?|размеры|условия|высота(?: шрифта)?)\s*:\s*(.*)$"
SECTION_MARK = r"(?iu)^(?:раздел|элемент маркировки|показатель)\s*:\s*(.+)$"
BARE_SECTION = r"(?iu)^([\p{L}][\p{L}\s/()–-]{2,80}):\s*$"
QUOTED_MARK = r"(?iu)^(?:нанести|указать|разместить)(?: на этикетке)?(?: (?:текст|надпись))?\s*:\s*[«“\"](.+)[»”\"]\s*[.]?$"
SIZE_SENTENCE = (r"(?iu)(?:не менее|не более|минимальн|максимальн|высота шрифта|размер букв)", r"(?iu)\d\s*(?:мм|см|%|mm|cm)")
INSTRUCTION = r"(?iu)(?:долж[еён]|следует|необходимо|требуется|указать|нанести|разместить|проверить|согласовать)"

# A stated dimension: number, spellings of millimetre that weak print turns into, comparators.
NUMBER, MILLIMETRE = r"(\d{1,3}(?:[.,]\d{1,3})?)", "(?:mm|мм|тт|rnm|mrn|rnrn|мт|тм)"
PERCENT = r"(?iu)([>≥<≤]|не\s+менее|более)?\s*(\d{1,3}(?:[.,]\d{1,2})?)\s*%"
AREA = r"(?iu)(\(?)\s*(\d{1,5}(?:[.,]\d{1,2})?)\s*(?:мм|mm)\s*[²2*?°\"”“'’`]"
EXCLUDED = r"(?iu)исключа\p{L}*\s+([^()\d]{3,60}?)\s*(?:\(|$)"
# Width and height of a label as its sheet states them.
SIDES = r"(?iu)(?<![\d.,])(\d{2,3}(?:[.,]\d{1,2})?)\s*[xх×*]\s*(\d{2,3}(?:[.,]\d{1,2})?)(?![\d.,]*\d)"
SIDES_TEXT = r"(?iu)размер[^\d]{0,80}?(?:этикетк|продукци|издели)[^\d]{0,80}?"
