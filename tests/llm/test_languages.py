"""Main text of pages in languages with and without listed stop words, with and without an article element."""

import pytest

from helixtable.llm import html

PAGES = {
    "en": ("A short title", "The committee met on Tuesday and decided to keep the old rules for now.", "Nobody in the room had expected that the vote would be so close in the end."),
    "ru": ("Короткий заголовок", "Комитет собрался во вторник и решил пока сохранить старые правила.", "Никто в зале не ожидал, что голосование окажется таким близким."),
    "it": ("Un titolo breve", "Il comitato si è riunito martedì e ha deciso di mantenere le vecchie regole.", "Nessuno nella sala si aspettava che il voto sarebbe stato così vicino."),
    "nl": ("Een korte titel", "De commissie kwam dinsdag bijeen en besloot de oude regels te behouden.", "Niemand in de zaal had verwacht dat de stemming zo spannend zou worden."),
    "pt": ("Um título curto", "O comité reuniu-se na terça-feira e decidiu manter as regras antigas.", "Ninguém na sala esperava que a votação fosse tão renhida no final."),
    "pl": ("Krótki tytuł", "Komitet zebrał się we wtorek i postanowił zachować dotychczasowe zasady.", "Nikt na sali nie spodziewał się, że głosowanie będzie tak wyrównane."),
    "ja": ("短い見出し", "委員会は火曜日に開かれ、当面は古い規則をそのまま維持することを決定しました。", "会場の誰も、投票がこれほど接戦になるとは予想していませんでした。"),
    "zh": ("简短的标题", "委员会于星期二召开会议，决定暂时保留原有的规则，直到明年再行讨论。", "会场里没有人预料到这次投票最后会如此接近，结果令所有人感到意外。"),
    "hu": ("Rövid cím", "A bizottság kedden ülésezett, és úgy döntött, hogy megtartja a régi szabályokat.", "Senki sem számított arra, hogy a szavazás ennyire szoros lesz a végén."),
    "fi": ("Lyhyt otsikko", "Valiokunta kokoontui tiistaina ja päätti säilyttää vanhat säännöt toistaiseksi.", "Kukaan salissa ei ollut odottanut, että äänestyksestä tulisi näin tiukka."),
    "el": ("Σύντομος τίτλος", "Η επιτροπή συνεδρίασε την Τρίτη και αποφάσισε να διατηρήσει τους παλιούς κανόνες.", "Κανείς στην αίθουσα δεν περίμενε ότι η ψηφοφορία θα ήταν τόσο οριακή."),
}
MENU = '<nav><ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li></ul></nav>'
PLAIN_MENU = '<ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li></ul>'
END = '<div class="comments"><p>I think this is the best of all and I said it first.</p></div><footer>&copy; example</footer>'


@pytest.mark.parametrize("language", PAGES)
@pytest.mark.parametrize("around", ['<div id="content">{}</div>', "<article>{}</article>", "<section><div>{}</div></section>"])
def test_whole_text_in_any_language(language, around):
    title, one, two = PAGES[language]
    body = around.format(f"<h1>{title}</h1><p>{one}</p><p>{two}</p>")
    for menu in (MENU, PLAIN_MENU):
        assert html.main_text(f"<html><body>{menu}{body}{END}</body></html>") == "\n".join(PAGES[language])


def test_what_stays_inside_an_article():
    _, one, two = PAGES["en"]
    for inner, kept in (
        (f"<noscript><p>{two}</p></noscript>", two),
        (f'<div class="social"><p>{two}</p></div>', two),
        (f'<div class="menu"><p>{two}</p></div>', two),
        ('<ul><li><a href="/x">First source</a></li><li><a href="/y">Second source</a></li></ul>', "First source\nSecond source"),
        ('<div class="social"><a href="/f">Share</a> <a href="/t">Tweet</a></div>', None),
        ('<ul class="menu"><li><a href="/f">Home</a></li></ul>', None),
        ("<nav><a href='/f'>Home</a></nav>", None),
        ('<div class="related"><p>The other story of the day is that it was on the way to be told.</p></div>', None),
    ):
        want = [one, *([kept] if kept else []), one]
        assert html.main_text(f"<article><p>{one}</p>{inner}<p>{one}</p></article>") == "\n".join(want), inner


def test_last_short_paragraph_before_comments_stays():
    _, one, two = PAGES["en"]
    page = f'<div id="post"><p>{one}</p><p>{two}</p><p>It is over.</p></div><div class="comments"><p>{one}</p></div>'
    assert html.main_text(page) == f"{one}\n{two}\nIt is over."
