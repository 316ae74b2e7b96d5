"""Line-first cleaning with quality rules, in DataFrame functions only.

Every line of a text is judged by itself; failing lines go, and a document that loses too much of its text is rejected. All of
it happens inside a row: there is no shuffle, a lost executor costs its own rows only, and a source or a group of copies of any
size is no hot spot.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .expressions import let, words


@dataclass(frozen=True)
class LineRules:
    """Bounds of the line rules.

    punctuation: a line fails with more than ``marks_percent`` marks (a symbol, or two ! or ? side by side) to 100 characters, or
    with digits and ASCII punctuation for over ``other_percent`` of its characters.
    navigation: a line fails with two free-standing separators or more, or if it is one of the usual menu entries and has at
    most ``menu_chars`` characters.
    boilerplate: a line of at most ``notice_chars`` characters fails if it holds one of the usual notices.
    A document is rejected if less than ``least_kept_percent`` of its characters stand in lines that pass.
    """

    marks_percent: int = 4
    other_percent: int = 50
    notice_chars: int = 200
    menu_chars: int = 60
    least_kept_percent: int = 50
    min_words: int = 50
    max_repeat_percent: int = 50


MARK = "[#*$%&|<>{}\\[\\]^~=]|!!|\\?\\?"
OTHER = "[\\x21-\\x40\\x5B-\\x60\\x7B-\\x7E]"
SEPARATORS = "\\s[|>»›·•/]\\s[^\\n]*\\s[|>»›·•/]\\s"
# Menu entries and notices of web pages in English, German, French and Spanish.
MENU_ENTRIES = (
    "home|menu|login|log in|sign in|sign up|search|next|previous|back|contact|contact us|about|about us|share|print|top|skip to (main )?content|"
    "startseite|men([üÜ]|ue)|anmelden|abmelden|registrieren|suche|suchen|weiter|zur([üÜ]|ue)ck|kontakt|([üÜ]|ue)ber uns|teilen|drucken|nach oben|zum inhalt( springen)?|"
    "accueil|connexion|se connecter|s'inscrire|rechercher|recherche|suivant|pr([éÉ]|e)c([éÉ]|e)dent|retour|nous contacter|([àÀ]|a) propos|partager|imprimer|haut de page|aller au contenu|"
    "inicio|men([úÚ]|u)|iniciar sesi([óÓ]|o)n|registrarse|buscar|siguiente|anterior|volver|contacto|acerca de|sobre nosotros|compartir|imprimir|ir al contenido"
)
NOTICES = (
    "all rights reserved|accept (all )?cookies|we use cookies|cookie policy|privacy policy|terms of (use|service)|enable javascript|click here|read more|subscribe to our|sign up for our|powered by|"
    "alle rechte vorbehalten|cookies akzeptieren|wir verwenden cookies|datenschutzerkl(ä|ae)rung|nutzungsbedingungen|javascript aktivieren|hier klicken|mehr lesen|newsletter abonnieren|"
    "tous droits r([éÉ]|e)serv([éÉ]|e)s|accepter les cookies|nous utilisons des cookies|politique de confidentialit([éÉ]|e)|conditions d'utilisation|activer javascript|cliquez ici|lire la suite|abonnez-vous|"
    "todos los derechos reservados|aceptar cookies|usamos cookies|utilizamos cookies|pol([íÍ]|i)tica de privacidad|t([éÉ]|e)rminos de uso|active javascript|haga clic aqu([íÍ]|i)|leer m([áÁ]|a)s|suscr([íÍ]|i)bete"
)
MENU = f"(?i)^[^\\p{{L}}]*({MENU_ENTRIES})[^\\p{{L}}]*$"
NOTICE = f"(?i)(^|[^\\p{{L}}])({NOTICES})($|[^\\p{{L}}])"


def line_fails(line: Column, rules: LineRules) -> Column:
    """If a line fails a rule. Lines without a word pass: they hold no text to lose."""

    def fails(n: Column) -> Column:
        punctuation = (F.regexp_count(line, F.lit(MARK)).cast("long") * 100 > n * rules.marks_percent) | (F.regexp_count(line, F.lit(OTHER)).cast("long") * 100 > n * rules.other_percent)
        navigation = line.rlike(SEPARATORS) | ((n <= rules.menu_chars) & line.rlike(MENU))
        boilerplate = (n <= rules.notice_chars) & line.rlike(NOTICE)
        return punctuation | navigation | boilerplate

    return let(F.length(line).cast("long"), fails) & line.rlike("[^ \\t-\\r]")


def repeated_words(word_list: Column) -> Column:
    """How many words stand in a 3-word window found twice or more in the list.

    Windows are compared by a 64-bit hash within one text; sorting (hash, position) puts equal windows side by side, in n log n
    steps for any text.
    """
    n = F.greatest(F.size(word_list) - 2, F.lit(0))
    hashed = F.slice(F.transform(word_list, lambda w, i: F.xxhash64(w, F.get(word_list, i + 1), F.get(word_list, i + 2))), 1, n)

    def again(s: Column) -> Column:
        return F.filter(s, lambda x, i: x.h.eqNullSafe(F.get(s, i - 1).h) | x.h.eqNullSafe(F.get(s, i + 1).h))

    def covered(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return let(placed, lambda s: F.size(F.array_distinct(F.flatten(F.transform(again(s), lambda x: F.array(x.i, x.i + 1, x.i + 2))))))

    return let(hashed, lambda h: F.when(F.size(F.array_distinct(h)) == n, 0).otherwise(covered(h)))


def quality_rules(docs: DataFrame, rules: LineRules = LineRules(), text: str = "text") -> DataFrame:
    """Adds the struct ``quality`` to every row of ``docs``.

    It has n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_failed_lines (long), base_failed and kept
    (boolean), and clean_text (the lines that pass, joined). A null or empty text has no words, so it fails the base; its clean text is empty. Rows are judged one by one:
    repeated rows get equal results, an empty table gives an empty table, and other columns pass through untouched. A column of
    ``docs`` named ``quality`` is replaced.
    """
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))

    def judged(t: Column, w: Column, lines: Column, kept_lines: Column) -> Column:
        n_words, solid = F.size(w).cast("long"), F.length(F.array_join(w, ""))
        n_repeat = repeated_words(w).cast("long")
        worded = F.filter(lines, lambda x: x.rlike("[^ \\t-\\r]"))
        base = let(n_repeat, lambda r: F.struct(r.alias("n"), ((n_words < rules.min_words) | (r * 100 > n_words * rules.max_repeat_percent)).alias("failed")))
        return let(base, lambda b: F.struct(
            n_words.alias("n_words"), solid.cast("long").alias("word_chars"), F.regexp_count(t, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
            let(worded, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"), b.n.alias("n_repeat_words"),
            F.size(lines).cast("long").alias("n_lines"), (F.size(lines) - F.size(kept_lines)).cast("long").alias("n_failed_lines"),
            b.failed.alias("base_failed"), (~b.failed & (F.length(F.array_join(kept_lines, "\n")).cast("long") * 100 >= F.length(t).cast("long") * rules.least_kept_percent)).alias("kept"), F.array_join(kept_lines, "\n").alias("clean_text"),
        ))

    result = let(whole, lambda t: let(words(t), lambda w: let(F.split(t, "\n"), lambda lines: let(F.filter(lines, lambda x: ~line_fails(x, rules)), lambda kept: judged(t, w, lines, kept)))))
    return docs.withColumn("quality", result)
