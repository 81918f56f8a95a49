"""Fixed values that results depend on: Hebrew word lists, affixes, weights and thresholds."""

# Cues that open and close an advertisement break, and advertisement phrases, at index time.
INDEX_AD_STARTS = (
    'הפסקה קצרה', 'הפסקת פרסומ', 'לטובת הפרסומ', 'לפרסומות', 'נחזור אחרי', 'ממשיכים אחרי', 'נשמע אחרי',
    'נחזור מיד', 'עוד רגע נחזור', 'אחרי ההפסקה', 'הולכים להפסקה', 'נעצור לרגע', 'ועכשיו לפרסומות',
    'פרסומות ונחזור', 'עוד מעט נחזור',
)

INDEX_AD_ENDS = (
    'ברוכים הבאים', 'חזרנו', 'אנחנו חוזרים', 'בחזרה', 'שוב איתכם', 'חוזרים ל', 'בואו נמשיך', 'אז חזרנו',
    'וחזרנו', 'ממשיכים', 'נמשיך',
)

INDEX_AD_PHRASES = (
    'סופר פארם', 'ביוטי דייס', 'ביוטי דייז', 'שופרסל', 'רמי לוי', 'יינות ביתן', 'אושר עד', 'בסניפי',
    'פריט שני ב', 'אחוז הנחה', '% הנחה', '70% הנח', '50% הנח', 'לשבוע אחד בלבד', 'למשך שבוע', 'עד גמר המלאי',
    'לפרטים נוספים', 'לפרטים התקשרו', 'התקשרו עכשיו', 'היכנסו ל', 'בכפוף לתקנון', 'ט.ל.ח', 'טלח', '1-800-',
    '1800', '*6', '*9', 'באתר שלנו', 'הזמינו עכשיו', 'ביטוח', 'פוליסה', 'הלוואה', 'מגוון מוצרי',
    'מוצרי איפור', 'מוצרי טיפוח', 'במחירים הכי נמוכים', 'אפשר יותר נמוך', 'שקלים בלבד', 'במבצע מיוחד',
    'שבמבצע', 'רק ב-', 'במחיר מיוחד', 'אמריקן קומפורט', 'גולדן בריץ', 'גולדן ברידג', 'קונים ב', 'מיטה ומזרן',
    'תיסוי מפנקת', '9,990 שקלים', '6,990 שקלים', 'שקלים וגם', 'הכל כדי ש', 'מסכים קונים', 'תנורים במחירים',
    'מקררים במחירים', 'נמוך מדי במחסן',
)

STATION_JINGLES = (
    'גלי ישראל החדשות', 'רדיו גלי ישראל', 'גלי צהל', 'כאן רשת ב', 'כאן מורשת', '103 אפ אם', 'רדיו 103',
)

# The later filter has lists of its own.
FILTER_AD_STARTS = (
    'הפסקה קצרה', 'הפסקת פרסומ', 'לטובת הפרסומ', 'נחזור אחרי', 'ממשיכים אחרי', 'נשמע אחרי', 'נחזור מיד',
    'עוד רגע נחזור', 'אחרי ההפסקה', 'הולכים להפסקה', 'נעצור לרגע',
)

FILTER_AD_ENDS = (
    'ברוכים הבאים', 'חזרנו', 'אנחנו חוזרים', 'בחזרה', 'שוב איתכם', 'חוזרים ל', 'בואו נמשיך', 'אז חזרנו',
)

FILTER_AD_PHRASES = (
    'סופר פארם', 'ביוטי דייס', 'ביוטי דייז', 'שופרסל', 'רמי לוי', 'יינות ביתן', 'אושר עד', 'בסניפי',
    'פריט שני ב', 'אחוז הנחה', '% הנחה', '70% הנח', '50% הנח', 'לשבוע אחד בלבד', 'למשך שבוע', 'עד גמר המלאי',
    'לפרטים נוספים', 'לפרטים התקשרו', 'התקשרו עכשיו', 'היכנסו ל', 'בכפוף לתקנון', 'ט.ל.ח', 'טלח', '1-800-',
    '1800', '*6', '*9', 'באתר שלנו', 'הזמינו עכשיו', 'ביטוח', 'פוליסה', 'הלוואה', 'אשראי', 'מגוון מוצרי',
    'מוצרי איפור', 'מוצרי טיפוח',
)

FILTER_JINGLES = (
    'כאן חדשות', 'כאן ב׳', "כאן ב'", 'רדיו כאן', 'גלי ישראל', 'גלי צה"ל', 'גלצ', '103fm', '103 fm',
    '103 אפ אם',
)

# Advertisement phrases of whole segments.
SEGMENT_AD_PHRASES = (
    'במחירים הכי נמוכים', 'אפשר יותר נמוך', 'שקלים בלבד', 'במבצע מיוחד', 'שבמבצע', 'רק ב-', 'במחיר מיוחד',
    'אמריקן קומפורט', 'גולדן בריץ', 'גולדן ברידג', 'מיטה ומזרן', 'תיסוי מפנקת', 'הכל כדי ש', 'מסכים קונים',
    'תנורים במחירים', 'מקררים במחירים', 'נמוך מדי במחסן',
)

# Query expansion.
QUERY_ALIASES = {
    'two-state solution': 'פתרון שתי מדינות',
    'two state solution': 'פתרון שתי מדינות',
    'abraham accords': 'הסכמי אברהם',
    'oslo accords': 'הסכמי אוסלו',
    'trump': 'טראמפ',
    'netanyahu': 'נתניהו',
    'bibi': 'ביבי',
    'knesset': 'כנסת',
    'likud': 'ליכוד',
    'coalition': 'קואליציה',
    'opposition': 'אופוזיציה',
    'sovereignty': 'ריבונות',
    'annexation': 'סיפוח',
    'settlements': 'התנחלויות',
    'settlers': 'מתנחלים',
    'tariffs': 'מכסים',
    'sanctions': 'סנקציות',
    'iron dome': 'כיפת ברזל',
    'idf': 'צה"ל',
    'air force': 'חיל האוויר',
    'hezbollah': 'חיזבאללה',
    'hamas': 'חמאס',
    'iran': 'איראן',
    'missile': 'טיל',
    'missiles': 'טילים',
    'ceasefire': 'הפסקת אש',
    'hostages': 'חטופים',
    'strait of hormuz': 'מצר הורמוז',
    'ballistic': 'בליסטי',
    'gdp': 'תוצר מקומי גולמי',
    'inflation': 'אינפלציה',
    'cost of living': 'יוקר המחיה',
    'budget': 'תקציב',
    'oil prices': 'מחירי נפט',
    'high-tech': 'הייטק',
    'high tech': 'הייטק',
    'startup': 'סטארטאפ',
    'el al': 'אל על',
    'netflix': 'נטפליקס',
    'champions league': 'ליגת האלופות',
    'barcelona': 'ברצלונה',
    'haredi': 'חרדים',
    'ultra-orthodox': 'חרדים',
    'conscription': 'גיוס',
    'education': 'חינוך',
    'bagrut': 'בגרויות',
    'egypt': 'מצרים',
    'sinai': 'סיני',
    'lebanon': 'לבנון',
    'syria': 'סוריה',
    'qatar': 'קטר',
    'flights': 'טיסות',
    'airport': 'שדה תעופה',
}

HEBREW_VARIANTS = {
    'חיזבאללה': ['חיזבולה', 'חזבאללה', 'חזבולה'],
    'נתניהו': ['ביבי', 'נתניאהו'],
    'אל על': ['אלעל'],
    'הייטק': ['היי טק', 'הי-טק'],
    'טראמפ': ['טרמפ', 'טרמאפ'],
}

CONCEPT_ALIASES = {
    'אינפלציה': 'עליית מחירים',
    'יוקר המחייה': 'עליית מחירים',
    'יוקר מחייה': 'עליית מחירים',
    'דפלציה': 'ירידת מחירים',
    'מיתון': 'האטה כלכלית',
    'אבטלה': 'מובטלים פיטורים',
    'משכנתא': 'הלוואה דירה משכנתאות',
    'בורסה': 'מניות שוק ההון',
    'פיגוע': 'טרור פצועים הרוגים',
    'נדלן': 'דירות מחירי דיור שכירות',
    'שביתה': 'עצירת עבודה שובתים',
    'הפגנה': 'מחאה מפגינים',
    'סנקציות': 'עיצומים',
    'נורמליזציה': 'הסכמי שלום',
    'פליטים': 'מהגרים מבקשי מקלט',
    'אקלים': 'התחממות גלובלית סביבה',
    'סייבר': 'אבטחת מידע האקרים',
    'קורונה': 'מגפה חיסונים תחלואה',
}

# Affixes, in the order in which they are tried.
PREFIXES = ("ב", "ל", "ה", "מ", "ו", "ש", "כ")
SUFFIXES = ("ים", "ות", "ה", "י", "ן", "ת", "ית", "יים", "יות")
# Repeated price slogans and slogan plus brand.
PRICE = r"\d[,.]?\d{3}\s*שקל"
LOWEST_PRICES, SHEKELS, TOO_LOW, BRANDS = "מחירים הכי נמוכים", "שקלים", "המחיר נמוך מדי", ("מחסני חשמל", "מחסן חשמל")
# Fusion weights and constants.
SIGNAL_WEIGHTS = {"sent_kw": 1.5, "seg_kw": 1.5, "phrase": 1.2, "seg_he": 0.8, "sent_he": 0.7, "sent_trgm": 0.4, "seg_trgm": 0.3, "topic": 0.15}
OTHER_WEIGHT, RRF_K, MAX_LIMIT, COSINE_GATE, LEAST_SCORE, FLOOR_SHARE = 0.3, 60, 50, 0.25, 0.008, 0.15
# Segmentation, topics, labels.
SEGMENT_SIMILARITY, SEGMENT_SECONDS, SEGMENT_LEAST, SEGMENT_WINDOW, TOPIC_SIMILARITY = 0.55, 300, 3, 6, 0.80
BIN_SECONDS, MERGE_GAP, LEAST_SPAN, SILENCE_DB, WINDOW_SECONDS = 0.1, 1.0, 0.5, -35, 2.0
SEMANTIC_THRESHOLD, TRIGRAM_THRESHOLD, QUALITY_THRESHOLD = 0.18, 0.3, 0.15
