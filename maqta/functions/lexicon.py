"""Word lists, letter tables and patterns that results depend on."""

from __future__ import annotations

# --- Fixed values: character classes ---------------------------------------------------------
#: White space of Unicode, as the body of a character class.
SPACE = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
DIACRITICS = r"\u0610-\u061a\u064b-\u065f\u0670\u06d6-\u06dc\u06df-\u06e8\u06ea-\u06ed\u0640"
CONTROLS = r"\u200b-\u200f\u202a-\u202e\u2066-\u2069\ufeff"
ARABIC = r"\u0621-\u064a"
ARABIC_DIGITS = r"\u0660-\u0669"
WORD = rf"[{ARABIC}{ARABIC_DIGITS}\u06f0-\u06f9A-Za-z0-9_]+"
DIGIT = r"\p{Nd}"

# --- Fixed values: letters and digits that are folded -----------------------------------------
FOLD_FROM = "أإآٱىئؤةکیڤگ"
FOLD_TO = "ااااييوهكيفك"
DIGITS_FROM = "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹"
DIGITS_TO = "01234567890123456789"

# --- Fixed values: affixes, in the order in which they are tried --------------------------------
PREFIXES = ["وبال", "وكال", "فبال", "وال", "فال", "بال", "كال", "لل", "ال", "وس", "فس", "و", "ف", "ب", "ل", "ك", "س"]
SUFFIXES = ["تهما", "كما", "هما", "تما", "ونها", "ات", "ان", "ون", "ين", "ها", "هم", "هن", "كم", "كن", "نا", "يه", "ته", "تي", "ه", "ي", "ت"]

# --- Fixed values: words without a topic --------------------------------------------------------
STOPWORDS = """
في من الى إلى على عن مع هذا هذه ذلك تلك هؤلاء أولئك التي الذي الذين اللذان
اللتان اللواتي اللاتي ما ماذا لماذا كيف أين متى هل لا لم لن ليس ليست إن أن
كان كانت يكون تكون قد لقد ثم أو أم بل لكن حتى إذا اذا إذ كل بعض غير أي عند
عندما بين حيث كما هو هي هم هن أنا نحن أنت أنتم له لها لهم به بها بهم فيه فيها
منه منها عليه عليها و ف ب ل ك يا وقد وهو وهي وفي ومن وعلى وإن وأن ولا ولم
the a an of to in on for and or is are was were be by with as at from this that
""".split()

# --- Fixed values: openings that announce a new topic, and that lean on what came before ----------
SHIFT = [
    "اما", "من ناحيه اخرى", "من جهه اخرى", "في المقابل", "على صعيد اخر", "على الصعيد", "بالانتقال الى", "ننتقل الى",
    "فيما يتعلق ب", "فيما يخص", "بالنسبه ل", "اولا", "ثانيا", "ثالثا", "رابعا", "خامسا", "اخيرا", "ختاما", "في الختام",
    "خلاصه القول", "في البدايه", "بدايه", "المحور", "الموضوع التالي",
    "however", "on the other hand", "in conclusion", "finally", "firstly", "secondly", "next",
]
CONTINUE = [
    "لذلك", "لذا", "ولذلك", "ولذا", "وبالتالي", "بالتالي", "وعليه", "عليه فان", "كما ان", "كما", "وكذلك", "كذلك", "ايضا",
    "علاوه على ذلك", "بالاضافه الى ذلك", "اضافه الى ذلك", "فضلا عن ذلك", "مما", "ما يعني", "اي ان", "بمعنى اخر", "وهذا",
    "وهذه", "هذا", "هذه", "ذلك", "تلك", "وذلك", "حيث", "اذ", "لان", "لكن", "ولكن", "الا ان", "غير ان", "ومع ذلك", "رغم ذلك",
    "مثلا", "على سبيل المثال",
    "therefore", "thus", "also", "moreover", "furthermore", "this", "these", "because", "for example", "but",
]

# --- Fixed values: sentence ends ------------------------------------------------------------------
TERMINATOR_RUN = r"(?:\.{3}|…|[.!?؟]+)"
CLOSERS = r"[\"'»”’)\]]*"
LINE_END = r"[.!?؟:…»”\"')\]]"
ABBREVIATIONS = [
    "هـ", "ه", "م", "ق.م", "ص", "ج", "د", "أ", "أد", "أ.د", "ت", "ط", "س", "ش", "إلخ", "الخ", "ا", "ب", "ع", "ر", "ل",
    "dr", "mr", "mrs", "ms", "prof", "st", "no", "vs", "etc", "e.g", "i.e", "inc", "ltd", "co", "jr", "sr", "fig", "vol", "pp", "p", "art", "sec",
]
AND_SO_ON = ["إلخ", "الخ", "etc"]
ERAS = ["هـ", "ه", "م", "ق.م"]
LIST_BULLETS = "-–—•●▪■◦*"
LIST_ORDINALS = ["أولاً", "ثانياً", "ثالثاً", "رابعاً", "خامساً", "سادساً", "سابعاً", "ثامناً", "تاسعاً", "عاشراً"]
ITEM_BULLETS = "-–•●▪*"

# --- Fixed values: where a long sentence may be cut ---------------------------------------------------
STRONG_MARKS = "[؛;]"
WEAK_MARKS = "[،,:]"
CONNECTIVES = ["لكن", "بينما", "إلا أن", "غير أن", "حيث", "بحيث", "كما أن", "إضافة إلى", "بالإضافة إلى", "علاوة على", "ثم", "أما", "لذلك", "لذا", "وبالتالي"]

# --- Fixed values: headings -----------------------------------------------------------------------------
ORDINALS = [
    "الأول", "الاول", "الأولى", "الاولى", "الثاني", "الثانية", "الثالث", "الثالثة", "الرابع", "الرابعة", "الخامس", "الخامسة",
    "السادس", "السادسة", "السابع", "السابعة", "الثامن", "الثامنة", "التاسع", "التاسعة", "العاشر", "العاشرة", "الحادي عشر",
    "الحادية عشرة", "الثاني عشر", "الثانية عشرة",
]
COMPOUND_ORDINAL_ENDS = ["عشر", "عشرة", "والعشرون", "والعشرين", "والثلاثون"]
#: Keyword pattern by level; a number or ordinal must follow.
LEGAL_KEYWORDS = {1: "الكتاب|القسم|الباب", 2: "الفصل", 3: "الفرع|المبحث", 4: "المطلب|(?:ال)?مادة|المادّة"}
STANDALONE_TITLES = [
    "مقدمة", "المقدمة", "تمهيد", "التمهيد", "الخاتمة", "خاتمة", "الخلاصة", "الملخص", "الملخص التنفيذي", "ملخص", "المراجع", "المصادر",
    "التوصيات", "النتائج", "الملاحق", "التعريفات", "تعريفات", "نطاق التطبيق", "الأحكام العامة", "الأحكام الختامية",
    "abstract", "introduction", "conclusion", "conclusions", "references", "summary",
]
HEADING_CHARS = 120
NUMBERED_WORDS = 10
