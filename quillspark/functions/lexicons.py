"""Word lists and patterns whose values decide results."""

# Spanish function words by class; "la", "los" and "las" are in two classes.
ARTICLES = "el la los las un una unos unas".split()
PREPOSITIONS = "a ante bajo con contra de desde en entre hacia hasta para por según sin sobre tras".split()
CONJUNCTIONS = "y e o u ni pero sino mas aunque que porque como si cuando donde mientras pues".split()
PRONOUNS = "yo tú él ella nosotros nosotras vosotros vosotras ellos ellas me te se nos os le les lo la los las mí ti sí conmigo contigo consigo esto eso aquello este ese aquel esta esa aquella".split()

# French and English words that mark code-switching in Spanish text; words shared with Spanish are left out.
FRENCH = "des du je il elle vous ils elles sont dans avec pas mais qui ce cette mon ton notre votre leur même très bien tout tous rien fait être avoir faire dire comme aussi encore alors donc où quand comment pourquoi ici là oui non peut autre peu trop jamais toujours chez après avant".split()
ENGLISH = "the and but not with from this that have has had was were been being are will would could should may might shall can must do does did what which who whom whose where when why how there here then than very just only also too so if or yet because although though while after before until since about into through between against above below each every all both few more most other some such any many much own same her his its our their my your".split()

# Marker words by language, of which the distinct ones present are counted.
MARKERS = {
    "es": "el la los las un una es en de que yo tú él".split(),
    "fr": "le la les un une est dans avec pour que je tu il".split(),
    "en": "the and is in of to a that it for".split(),
}

# Lines that are editorial apparatus, by kind, in order; all but the last three ignore case, accented letters too.
EDITORIAL = {
    "TOC marker": r"(?iu)^(índice|tabla de contenido|contenido|table of contents)\s*$",
    "Copyright": r"(?iu)(copyright|©|todos los derechos reservados|derechos reservados)",
    "ISBN": r"(?iu)ISBN[\s0-9-]{10,20}",
    "Publisher blurb": r"(?iu)^(editorial\s|published by|publicado por|colección|biblioteca)",
    "Page number": r"^\s*[0-9]+\s*$",
    "Running header": r"^[A-ZÁÉÍÓÚÑ][A-ZÁÉÍÓÚÑ\s]{2,39}$",
    "Chapter header": r"(?iu)^(capítulo|cap\.?|parte|part|section|sección)\s*([0-9]+|[IVX]+)",
}
BLURB_LENGTH, HEADER_LENGTH = 200, 50

# What an answer must not contain, whatever the case.
FORBIDDEN = ["###", "Instrucción:", "Pasaje:", "Respuesta:", "Nota:", "Note:", "Explicación:", "Explanation:", "markdown", "razonamiento", "reasoning", "Thinking Process", "<think>", "</think>", "* ", "- ", "# "]

# Beginnings of answers that leak reasoning.
LEAKS = ["thinking process:", "reasoning:", "analysis:", "chain of thought:", "1. **analyze", "1. analyze"]

# Labels of failed cases, in order.
FAILURES = ["semantic_drift", "target_miss", "length_guardrail", "lexical_overlap", "stalled_revision"]

# Fixed values of the parser by rules: articles, subordinators with the clause they open, endings of verbs.
DETERMINERS = set("el la los las un una unos unas the a an der die das ein eine le les une".split())
SUBORDINATORS = {w: "ccomp" for w in "que that dass qu".split()} | {w: "advcl" for w in "si cuando porque aunque mientras if when because although while wenn weil obwohl quand lorsque".split()}
VERB_ENDING = "(ar|er|ir|ando|iendo|aba|ed|ing|ten|ent)$"

# What goes from a chapter page before its text is read, in this order.
CHAPTER_NOISE = [
    r"(?s)<h3[^>]*>.*?</h3>",
    r'(?s)<p[^>]*class="[^"]*derecha[^"]*"[^>]*>.*?</p>',
    r'(?s)<p[^>]*class="centrado"[^>]*>\s*\*\s*\*\s*\*\s*</p>',
    r"(?s)<p[^>]*>\s*\(\*Nota edici[oó]n epub:.*?\).*?</p>",
    r"(?s)<p[^>]*>\s*</p>",
]

# Paragraphs of visible reasoning before an answer, and a comment after it.
REASONING_PREFIX = r"^(?iu)(?:\s*(?:\*{0,2}\s*)?(?:(?:thinking process|reasoning|analysis|chain of thought|an[áa]lisis|comentario|commentary|nota|note|cambios realizados|changes made)\s*:\s*(?:\*{0,2}\s*)?[^\n]*?\n\s*\n|[0-9]+\.\s+\*\*?analyze\*\*?)\n?)+"
COMMENT_SUFFIX = r"(?isu)\n\s*\n((?:\*\*)?\s*(?:nota|note|notes|explicaci[oó]n|explanation|comentario|commentary|justificaci[oó]n|justification|cambios realizados|changes made)\s*:\s*(?:\*\*)?).*$"

# How a chapter's heading begins in running pages, with its number.
CHAPTER_MARKER = r"(?:CAPÍTULO|Capítulo|Cap\.?|PARTE|Parte|Part)\s*(?:Nº?\s*)?([0-9]+|[IVX]+)"
