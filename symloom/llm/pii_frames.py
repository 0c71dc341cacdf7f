"""Sentences written by hand for the tagger's training, beside the labels of real documents.

Slots are filled with coined values and with common names, in several scripts and cases; the spans are
known by construction.
"""

from __future__ import annotations

import random

# Common first names and surnames of several languages.
FIRST = "James Mary John Linda Robert Susan Michael Karen David Nancy Thomas Laura Daniel Emma Anna Peter Julia Hans Greta Klaus Heike Jürgen Ute Pierre Chloé Jean Marie Luc Élodie José María Carlos Lucía Javier Sofía Giulia Marco Ana João Ingrid Lars Piotr Agnieszka Ivan Olga Mehmet Fatma Ahmed Layla Ravi Priya Wei Mei Kenji Yuki Kwame Amina Catherine Edmund Rebecca Gregory Florence Leonard Beatrice Howard Rosalind Stephen Winifred Duncan Matilda Sebastian Annika Gerhard Lieselotte Étienne Margaux Thibault Rodrigo Mercedes Ignacio Consuelo Federico Ludovica Henrik Astrid Dmitri Svetlana Stavros Eleni".split()
LAST = "Smith Jones Brown Taylor Wilson Davies Evans Walker Green Baker Clark Hall Young King Wright Müller Schmidt Schneider Fischer Weber Becker Hoffmann Schäfer Dupont Durand Moreau Lefèvre Roux García Fernández López Sánchez Rossi Ferrari Silva Santos Hansen Nielsen Kowalski Nowak Petrov Ivanova Yılmaz Kaya Hassan Haddad Patel Sharma Chen Wang Tanaka Suzuki Mensah Okafor O'Brien McCarthy Van Dyke Hawthorne Blackwood Pemberton Fairchild Livingston Armstrong Richardson Bellamy Kensington Ashworth Thornton Gallagher Donovan Winchester Langford Marlowe Prescott Sinclair Hollis Wetherby Lindgren Bergström Holmqvist Steinmetz Brandauer Rosenthal Vogt Lehmann Winterfeld Delacourt Montclair Fontaine Rousselet Beauchamp Charpentier Villanueva Casares Montoya Salcedo Escalante Quiroga Bianchi Castellani Papadopoulos Georgiou Sokolov Kuznetsova Adeyemi".split()
TITLES = {"en": ("Mr", "Mrs", "Ms", "Dr", "Mr.", "Mrs.", "Ms.", "Dr.", "Prof.", "Miss"), "de": ("Frau", "Herr", "Herrn", "Dr."), "fr": ("Mme", "M.", "Mlle", "Monsieur", "Madame"), "es": ("Sr.", "Sra.", "Señor", "Señora", "Don")}
ROADS = ("Street", "Road", "Lane", "Avenue", "Drive", "Close", "Court", "Way", "Terrace", "St", "St.", "Rd", "Ave", "Blvd", "Square")

# {p} a person, {t} a title with a surname, {e} an e-mail address, {f} a phone number, {n} an identity number, {a} an address, {w} a name that is nobody's.
FRAMES = """My name is {p} and I live at {a}.
name: {p}, phone: {f}, email: {e}
Please call {p} on {f} before noon.
Dear {t}, thank you for your letter.
Signed, {p}
See {t} about it.
As {p} said, the meeting starts late.
{p} moved to {a} last spring.
The parcel for {p} was left at {a}.
Contact: {p} <{e}>
Attn: {p}, {a}
I spoke to {t} and to {p} on the phone.
Her passport number is {n}.
A passport no. {n} was found.
The form shows passport no. {n} and the fax {f}.
SSN: {n}
My social security number is {n}, as you asked.
national insurance number: {n}
tax ID {n} belongs to {p}.
Driver's licence {n}, issued to {p}.
Write to {e} or ring {f}.
tel. {f}
Phone {f} (ask for {t}).
Fax: {f}, mail: {e}
Send it to {a}, please.
He lives at {a} with {p}.
Their office is at {a}. Ring {f}.
The witness, {p}, gave {e} as an address.
Born in a village, {p} studied law.
{p} and {p} wrote the report.
Reported by {p} ({e}).
"author": "{p}", "mail": "{e}"
assignee={p}
Minutes taken by {p}; present: {p}, {p}.
{t} will see you now.
Thanks to {p} for the review.
Herr Kollege {p} prüft das. Telefon {f}.
Mein Name ist {p}, ich wohne {a}.
Bitte rufen Sie {t} unter {f} an.
Meine Ausweisnummer lautet {n}.
Die Adresse von {p}: {a}
Je m'appelle {p}, mon adresse est {a}.
Veuillez contacter {t} au {f}.
Numéro de sécurité sociale : {n}
Me llamo {p} y vivo en {a}.
Llame a {t} al {f}.
Mi número de identidad es {n}.
hi {p}, can you look at this?
from: {p} <{e}>
patient {p}, seen on Monday, lives at {a}
we met {p} at the gate
regards, {p}
Last week {p} came by with the keys.
On Tuesday {p} will open the shop.
The letter from {p} arrived late.
We thanked {p} and left.
After lunch {t} called again.
The porter told {t} that the hall was closed.
Nobody saw {p} leave the house.
Then {p}, who had waited, spoke.
Before that, {p} had worked in a bakery.
This was seen by {p} and by {t}.
Ask {p} or {p} for the form.
{p} will be there, and so will {t}.
Heute hat {p} angerufen.
Wir haben {t} gestern getroffen.
Nach der Sitzung ging {p} nach Hause.
Ce matin {p} est venu avec {t}.
Nous avons vu {t} à la gare.
Ayer {p} llegó tarde a la reunión.
Hablamos con {t} en el pasillo.
Вчера {p} приехал в город.
Договор подписала {p} вместе с коллегой.
Χθες ο {p} έφυγε νωρίς.
ask {p} about the form
we gave it to {t} last night
the keys are with {t} today
i am {p}, from {a}
my address is {a}
it was sent to {a} on friday
Our landlord {p} raised the rent again.
In the evening {t} read the report aloud.
Everyone at the table knew {p} from school.
{p} plays the cello in {w}.
Was it {p} who left the window open?
The prize went to {p}, not to {p}.
Since March {p} has led the {w} team.
The lawyer of {p} declined to comment.
Her cousin, {t}, owns the mill.
A word from {t} would help.
Nobody but {p} has the code.
{p} joined {w} as an engineer.
The nurses know {t} well.
What {p} meant was not clear.
According to {p}, {w} will close.
They live opposite, at {a}, above the shop.
The clinic has moved to {a}; parking is behind it.
There was a fire at {a} this morning.
Bills are to be sent to {a}.
You will find us at {a}, second floor.
Leave a message on {f}, or mail {e}.
The new number of the shop is {f}.
Text {f} if you are late.
The line {f} was busy all day.
The address {e} bounced.
Replies to {e} only.
Whoever finds it should tell {e}.
His SSN, {n}, stood on the slip.
The clerk copied passport number {n} twice.
Her identity card, no. {n}, has expired.
Am Abend rief {t} noch einmal zurück.
Das Paket ist für {p} bestimmt.
Der Vertrag mit {p} läuft aus.
Kennen Sie {p}? Wohnhaft in {a}.
Die Rechnung geht an {a}.
Unsere Nummer ist {f}.
Ensuite {t} a pris la parole.
C'est {p} qui garde la clé.
Elle habite {a} depuis un an.
Le dossier de {t} est complet.
La carta era para {p}.
Ayer vimos a {t} en el mercado.
Su vecino {p} trabaja en {w}.
Vive en {a} con su hermana.
Рядом с ним сидела {p}.
Το γράμμα το έστειλε ο {p}.
i saw {p} at the market
tell {t} i said hello
thanks, {p}
call me on {f} or write to {e}""".split("\n")

# Nothing of that kind, though it looks like it.
PLAIN = """The North Gate opens at 10 and Main Hall closes at 18.
Release 4.12.0 of Blue Harbor replaces Red Canyon.
Error 4041234567 at offset 88120034 in block 19.
Order 2024-118-0042 was shipped with invoice 70012345.
See Section 4 of the User Guide, Table 12, or Appendix B.
Version 10.0.19045 build 20240715 runs on port 8443.
The Quick Start guide and the Service Level page agree.
Monday, March 12 and Tuesday, April 13 are free.
Clone git@host.example:team/repo.git and pin pkg@1.2.3.
Rows 100000 to 250000 were read in 3.25 seconds.
Der Lange Weg ist ein Buch, Kapitel 12, Seite 340.
La Grande Ligne passe par le pont numéro 7.
El Puente Nuevo tiene 120 metros.
New York and Los Angeles are far apart.
set timeout=30000 retries=5 id=550e8400-e29b-41d4-a716-446655440000
HTTP 502 from 10.0.12.7 after 1200 ms, trace 9f86d081884c7d65
the open road to the north has 2 lanes
Open Source Software and Machine Learning are buzzwords.
San Francisco and Hong Kong are on the list, North Korea is not.
The United Kingdom, Costa Rica and Sri Lanka signed in April 2023.
The sum came to 2,310,400.50 in May 2022, up from 1,990,312.00.
Yesterday Blue Harbor went down for 12 minutes.
The Golden Gate dashboard and the White Paper are linked below.
On Tuesday Open Office hours begin at 10.
Last Week and Next Month are the two filters.
The total of 310 was paid in March.
Nach Version 12 folgt Version 13, das Handbuch Teil 2 fehlt.
Le Petit Journal publie 12 pages, El Gran Canal tiene 3 puertas.
В разделе Общие Положения есть 12 пунктов.
Call Center and Help Desk share one queue; Red Team and Blue Team do not.
{w} opens in June, {w} follows a week later.
Today the {w} build failed, so {w} took over.
We compared {w} with {w} on 12 hosts.
The {w} page links to {w}.
In {w} the harvest was late.
{w}, {w} and {w} are on the list.
Tickets for {w} cost 12 dollars.
They flew to {w} and on to {w}.
After {w} came {w}, in 2021.
See {w}, Chapter 4, for the rest.
From {w} to {w} it is 310 miles.
{w} has 24 rooms and 3 halls.
Die {w} tritt im Mai in Kraft.
Der {w} und das {w} haben geöffnet.
Le {w} et la {w} sont fermés.
El {w} y la {w} abren a las 9.
Set {w} to 12 before {w} starts.
Dear {w} team, the job is done.
Thanks to {w} the run took 40 seconds.""".split("\n")

# Words of names that are nobody's: products, places, titles of things.
PROPER = {
    ("Blue", "Red", "Green", "Silver", "Golden", "Amber", "Iron", "Quiet", "Little", "Grand", "Great", "Old", "High", "Deep", "Open", "Royal", "Central", "National", "General", "Early", "Second", "Free", "White", "Black", "Clear", "Wild"): ("Harbor", "Canyon", "River", "Valley", "Falcon", "Summit", "Ledger", "Bridge", "Garden", "Museum", "Library", "Station", "Market", "Forest", "Lake", "Engine", "Stack", "Report", "Council", "Festival", "Court", "House", "Theatre", "Project", "Guide", "Line"),
    ("North", "South", "East", "West", "Northern", "Southern", "New", "San", "Santa", "Saint", "Port", "Upper", "Lower", "Mount", "Cape", "Fort"): ("Carolina", "Dakota", "Macedonia", "Ireland", "Sudan", "Timor", "Virginia", "Jersey", "Mexico", "Hampshire", "Diego", "Barbara", "Moresby", "Town", "Saxony", "Marino", "Lucia", "Wales", "Territory", "Caledonia"),
    ("Neue", "Neuer", "Alte", "Alter", "Große", "Großer", "Kleine", "Erste", "Zweite", "Hohe", "Deutsche", "Allgemeine"): ("Ordnung", "Vertrag", "Brücke", "Bericht", "Markt", "Bahn", "Bank", "Regel", "Ausgabe", "Halle", "Zeitung", "Rat"),
    ("Petit", "Grand", "Nouveau", "Grande", "Nueva", "Gran", "Primera", "Buenos", "Costa", "Sierra"): ("Palais", "Théâtre", "Marché", "Plaza", "Norma", "Guía", "Aires", "Brava", "Nevada", "Edición"),
}

_AT = ("@", "@", "@", "@", " (at) ", " [at] ", "(at)")
_CYRILLIC = dict(zip("abcdefghijklmnopqrstuvwxyz", "абцдефгхийклмнопкрстувшкиз"))
_GREEK = dict(zip("abcdefghijklmnopqrstuvwxyz", "αβκδεφγηιικλμνοπκρστυβωξυζ"))


def _digits(rng: random.Random, form: str) -> str:
    return "".join(str(rng.randint(0, 9)) if c == "#" else chr(65 + rng.randrange(26)) if c == "@" else c for c in form)


def _name(rng: random.Random, words: tuple[str, ...], coined) -> str:
    """A common name, one coined of syllables, or the head of one common name with the tail of another."""
    r = rng.random()
    if r < 0.35:
        return rng.choice(words)
    if r < 0.6:
        return coined(rng, rng.choice((2, 2, 3)))
    head, tail = rng.choice(words), rng.choice(words)
    made = head[: max(2, len(head) // 2)] + tail[len(tail) // 2 :].lower()
    return made if made.isalpha() and made[1:].islower() else head


def _value(kind: str, rng: random.Random, coined) -> tuple[str, str, str]:
    """(text before, value, kind; none for names that are nobody's)."""
    first, last = _name(rng, FIRST, coined), _name(rng, LAST, coined)
    if kind == "p":
        r = rng.random()
        value = f"{first} {last}" if r < 0.6 else f"{first} {rng.choice('ABCDEFGHJKLMNRST')}. {last}" if r < 0.7 else f"{rng.choice('ABCDEFGHJKLMNRST')}. {last}" if r < 0.78 else f"{last}, {first}" if r < 0.84 else f"{first}\n{last}" if r < 0.9 else f"{first} {last}-{_name(rng, LAST, coined)}" if r < 0.95 else rng.choice((f"{first} {last.upper()}", f"{last.upper()}, {first}"))
        if rng.random() < 0.1:
            script = rng.choice((_CYRILLIC, _GREEK))
            value = "".join(script.get(c, c) if c.islower() else script[c.lower()].upper() if c.lower() in script else c for c in value)
        return "", value, "person"
    if kind == "t":
        title = rng.choice(rng.choice(list(TITLES.values())))
        return title + rng.choice((" ", " ", " ", "\n")), (rng.choice("ABCDEFGHJKLMNRST") + ". " if rng.random() < 0.1 else "") + last, "person"
    if kind == "w":
        before, behind = rng.choice(list(PROPER.items()))
        return "", rng.choice(before) + " " + rng.choice(behind), ""
    if kind == "e" and rng.random() < 0.12:
        return "", f"{first.split()[0]}{rng.choice(('.', '_', ''))}{last.split()[0]} at {coined(rng, 2)} dot {rng.choice(('com', 'org', 'de', 'net', 'test'))}".lower().replace("'", ""), "email"
    if kind == "e":
        return "", rng.choice((f"{first}.{last}", f"{first[0]}{last}", f"{last}{rng.randint(1, 99)}", f"{first}_{last}", "info", first)).lower().replace(" ", "").replace("'", "") + rng.choice(_AT) + rng.choice((coined(rng, 2), coined(rng, 2), f"{coined(rng, 1)}-{coined(rng, 2)}")).lower() + rng.choice((".com", ".org", ".de", ".example", ".co.uk", ".test")), "email"
    if kind == "f":
        return "", _digits(rng, rng.choice(("+1 (###) ###-####", "(###) ###-####", "###-###-####", "+44 #### ######", "+49 ### #######", "0## #######", "0#### ######", "+33 # ## ## ## ##", "+34 ### ### ###", "0# ## ## ## ##", "+############", "0###/######"))), "phone"
    if kind == "n":
        return "", _digits(rng, rng.choice(("###-##-####", "@@ ## ## ## @", "@########", "##-#######", "########@", "@@#######", "## ### ### ###", "@#######@", "#########", "# ## ## ## ### ### ##"))), "id_number"
    road = coined(rng, 2)
    town = coined(rng, 2)
    r = rng.random()
    if r < 0.55:
        value = f"{rng.randint(1, 999)}{rng.choice(('', '', '', 'b'))} {road} {rng.choice(ROADS)}" + rng.choice(("", "", f", {town}", f", Flat {rng.randint(1, 40)}, {town}", f", {town} {_digits(rng, '#####')}"))
    elif r < 0.75:
        value = rng.choice((f"{road}straße {rng.randint(1, 199)}", f"{road}weg {rng.randint(1, 99)}", f"Am {road} {rng.randint(1, 99)}")) + rng.choice(("", f", {_digits(rng, '#####')} {town}"))
    elif r < 0.88:
        value = f"{rng.randint(1, 99)}, {rng.choice(('rue', 'avenue', 'place'))} {rng.choice(('de ', 'du ', ''))}{road}" + rng.choice(("", f", {_digits(rng, '#####')} {town}"))
    elif r < 0.95:
        value = f"{rng.choice(('Calle', 'Avenida', 'Plaza'))} {road} {rng.randint(1, 150)}" + rng.choice(("", f", {_digits(rng, '#####')} {town}"))
    else:
        value = rng.choice((f"P.O. Box {rng.randint(10, 9999)}", f"Postfach {rng.randint(10, 9999)}")) + rng.choice(("", f", {town}"))
    return "", value, "address"


def composed(rng: random.Random, coined, n: int) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """n texts of one to three sentences each, with their spans; some in small letters throughout."""
    out = []
    for _ in range(n):
        text, spans = "", []
        for _ in range(rng.randint(1, 3)):
            frame = rng.choice(FRAMES if rng.random() < 0.8 else PLAIN)
            at = 0
            while (k := frame.find("{", at)) >= 0 and frame[k + 1 : k + 3] in ("p}", "t}", "e}", "f}", "n}", "a}", "w}"):
                text += frame[at:k]
                before, value, kind = _value(frame[k + 1], rng, coined)
                if kind:
                    spans.append((len(text) + len(before), len(text) + len(before) + len(value), kind))
                text += before + value
                at = k + 3
            text += frame[at:] + rng.choice((" ", "\n", "\n\n"))
        out.append((text.lower() if rng.random() < 0.15 and len(text.lower()) == len(text) else text, spans))
    return out
