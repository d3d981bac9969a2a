"""The small labelled table that the mention tagger learns from.

Fixed values throughout: sentences with slots in braces and values for the slots, all invented. ``{e}`` is an
email address, ``{p}`` a phone number, ``{i}`` an identity number, ``{a}`` a street address, ``{n}`` a
person. ``{x}`` is a project, ``{t}`` a ticket, ``{d}`` a date, ``{f}`` a file, ``{v}`` a version, ``{c}`` a
commit, ``{o}`` an order, amount or other
number, ``{b}`` a build: none of these is personal. ``{s}``, ``{S}`` and ``{U}`` are invented words in small letters, with a capital, and in
capitals. Everything outside the first five slots is labelled as no mention.
"""

EMAILS = """
{s}.{s}@{s}.example
{s}_{s}+list@mail.{s}.example
{s}-m@{s}.test
m{s}@team.{s}.invalid
{s}42@de.{s}.test
{U}.{U}+CACHE@CORP.{U}.EXAMPLE
{U}07@{U}.INVALID
{s}.{s} (at) {s}.test
{s}-m (at) corp.{s}.example
{s}_{s}[at]{s}[dot]test
{s}[at]team[dot]{s}[dot]invalid
{s}.{s} @ {s}.example
{s}-m @ mail.{s}.test
{s}51 (at) {s}.invalid
{s}@{s}.com
{s}.{s}@{s}.co.uk
{s}_{s}@{s}.org
info@{s}.de
{s}99@mail.{s}.net
{s}+news@{s}.io
{s}{s}@{s}.fr
{S}.{S}@{s}.com
{s} at {s} dot com
"""

PHONES = """
+49 30 23125 871
+49 (0)30 23125714
0049-30-23125338
030 23125-604
+44 20 7946 0955
+44-20-79460812
(020) 7946-0642
020 7946 0273
+33 1 99 00 72 15
+33(0)199006341
01 99 00 12 88
01.99.00.47.36
+31 85 555 7261
+7 (000) 418-27-63
8 000 731 52 94
085-5552364
+7 000 219-84-16
+1 415 555 0182
+1-415-555-0147 ext. 318
415-555-0163
415.555.0129
(415) 555-0138
14155550176
+33 1 99 00 61 47
555-867-5309
(212) 555-0199
212-555-0147
212.555.0188
+1 (646) 555-0133
1-800-555-0172
+44 (0)20 7946 0321
07700 900418
+44 7700 900 233
06 39 98 14 27
+33 6 39 98 42 05
0171 3920157
+49 171 39200 48
0211/5684-20
+34 612 004 577
912 345 678
+351 912 345 008
06 5555 1234
+39 333 200 4471
020-5551234
06-12345678
+31 6 12345678
+7 495 123-45-67
8 (495) 123-45-67
+1 555 0147 x42
"""

IDNUMS = """
931-48-2207
931 48 2207
931482207
71 204 386 915
1 84 07 00 412 336 58
2 91 11 00 087 554 03
QR 48 15 62 C
QR481562C
48213765K
48213765-K
48.213.765-K
71.204.386.915
71204386915
464 018 275
4518 302765
9 31 48 22 07
BNCLRA72D41Z604Q
9145.62.338
02841763 5 YB4
45 18 302765
LK27M490P
K4830261
X7720415
904-71-6638
954 20 1183
123-45-6789
219-09-9999
AB 12 34 56 C
AB123456C
943 476 5919
P1234567
C01X00T47
X1234567L
12345678Z
2 55 08 14 168 025 38
2550814168025
12 345 678 901
RSSMRA85T10A562S
111222333
4512 889034
G7719302
D612-4407-2290
"""

ADDRESSES = """
84 {S} Street
27 Old {S} Road
163 {S} Lane
59 {S} Ave
118 {S} Rd.
54d {S} Ave
9 {S} Rd.
127a Old {S} Road
{S}straße 31
{S}str. 14
{S}-Allee 77
{S}weg 5
{S}straat 96
{S}laan 12
{S}weg 41
121 rue de {S}
78 chemin du {S}
101, avenue {S}
6 rue {S}
147 bis bd {S}
41 bis rue de {S}
33, boulevard {S}
Paseo de {S}, 102
Plaza {S} 7
пр. {S}, д. 12
Piazza {S} 37
via {S}, 51
{S}kade 87
Am {S}weg 3
{S}-Allee 152c
Calle {S} 24
C/ {S}, 171
Avda. de {S} 46
Rua de {S}, 97
Av. {S} 63
Av. {S} 60a
Travessa do {S}, 57
Via {S} 124
Corso {S}, 32
Viale {S} 8
ул. {S}, д. 89
улица {S}, 48
221B {S} Street
12 {S} Street
7 {S} Avenue
1600 {S} Ave.
45 {S} Drive
9 {S} Close
300 North {S} Boulevard
15 {S} Court
88 St. {S} Road
4 {S} Square
{S} Street 14
12 rue de la {S}
5 rue {S}
27 avenue de la {S}
3 place {S}
{S}gasse 12
{S} Straße 18
Alte {S}str. 9
{S}platz 4
Calle de {S} 8
Avenida {S}, 120
Rua {S}, 45
Rua do {S} 7
Via {S} 21
Piazza {S}, 3
{S}gracht 201
{S}singel 33
{S}plein 6
ул. {S}, 12
проспект {S}, д. 5
63 {S} Crescent
18 {S} Terrace
5 {S} Place
240 {S} Way
31 {S} Hill
77 {S} Park Road
8 {S} Gardens
"""

FILES = "docs/{s}_loader.py config/{s}_cache.yaml src/{s}_graph.ts tools/{s}_notes.md api/{s}_chunk.go".split()
TICKETS = "KG-48213 WEB-90417 MEM-5521 OPS-77310 PAL-1208 #4821 JIRA-77".split()
DATES = "2022-03-19|2024-11-02|2020-07-30|2025-01-08|19.03.2022|3 May|12/04/2023|Tuesday|14:30".split("|")
VERSIONS = "v3.14.2 v0.27.11 v8.5.0 v6.30.17 v5.9.14 v0.7.12 v10.2.0 v4.4.19 3.11.4".split()
BUILDS = "318-27-4094 52-618-7731 409-172-3387 61-44-9012 3871-264/15 0031847719206 00418273645 204-118-5530".split()
COMMITS = "7be04f1 91c3d2e 40aa9b7 d2f8810".split()
NUMBERS = "1,250.00|48 213|7719|99.5|€ 349|$1200|12 000 000|2048|31|0.75|400 g|17 km|10 %|page 214|room 12|ISBN 978-3-16-148410-0|order 55120938|invoice 2024-00417|19:45|52.5200".split("|")

SENTENCES = """
You can reach me at {e} if {x} breaks again.
Forward the {t} log to {e} please.
The invite for {x} bounced, the address was {e}
cc {e}, they own {x}.
reporter={e} status=open ticket={t}
Schick die Unterlagen zu {x} bitte an {e}, danke.
Meine neue Adresse für Post zu {t} lautet {e}
Envoie le dossier {x} à {e}, merci.
Mon adresse pour {t} est désormais {e}
Manda los papeles de {x} a {e}, gracias.
Mi correo para {t} es {e}
Envia a pasta de {x} para {e}, obrigado.
O meu email para {t} passou a ser {e}
Manda i documenti di {x} a {e}, grazie.
Il mio indirizzo per {t} ora è {e}
Stuur de stukken van {x} naar {e}, bedankt.
Mijn nieuwe adres voor {t} is {e}
Отправьте документы по {x} на {e}, спасибо.
Моя почта для {t} теперь {e}
{e}
Call me on {p} before the demo.
My number is {p}, text is fine.
The pager for {x} rings at {p} now.
If the door stays shut, dial {p} and mention {t}.
mobile: {p}
Rufnummer für Notfälle bei {x}: {p}
Du erreichst mich unter {p}, am besten vormittags.
Numéro d'astreinte pour {x} : {p}
Tu peux me joindre au {p} après midi.
Teléfono de guardia de {x}: {p}
Me puedes llamar al {p} por la tarde.
Podes ligar-me para o {p} à tarde.
Telefone de serviço de {x}: {p}
Mi trovi al numero {p} nel pomeriggio.
Numero di reperibilità per {x}: {p}
Je kunt me bellen op {p} na vier uur.
Storingsnummer van {x}: {p}
Мой номер {p}, звоните после обеда.
Телефон дежурного по {x}: {p}
{p}
The form wants my social security number, {i}, for {x}.
For the contract use tax id {i}.
Passport no. {i} was scanned into {f}.
National ID {i} appears in the {t} attachment.
id card: {i}
Im Antrag zu {x} steht meine Ausweisnummer {i} noch drin.
Die Steuernummer {i} gehört nicht in {t}.
Mon numéro de sécurité sociale {i} traîne encore dans {f}.
Passeport {i}, à retirer de {t} svp.
Mi DNI {i} sigue guardado en {f}.
Quita el pasaporte {i} de {t}, por favor.
O meu número de contribuinte {i} ainda está em {f}.
Tira o cartão de cidadão {i} de {t}, por favor.
Il mio codice fiscale {i} è ancora dentro {f}.
Togli la carta d'identità {i} da {t}, per favore.
Mijn burgerservicenummer {i} staat nog in {f}.
Haal paspoort {i} uit {t}, alsjeblieft.
Номер паспорта {i} остался в файле {f}.
Уберите ИНН {i} из {t}, пожалуйста.
{i}
I moved, the new address is {a} as of {d}.
Visit the {x} people at {a} tomorrow.
Ship the test device to {a}, the bell is broken.
The old badge was mailed to {a} in error.
Das Paket für {x} geht an {a}, zweiter Stock.
Ab {d} wohne ich in der Nähe, nämlich {a}.
Le colis pour {x} part au {a}, deuxième étage.
Depuis {d} j'habite tout près, au {a}.
El paquete para {x} va a {a}, segundo piso.
Desde {d} vivo cerca, en {a}.
A encomenda de {x} segue para {a}, segundo andar.
Desde {d} moro aqui perto, em {a}.
Il pacco per {x} va in {a}, secondo piano.
Dal {d} abito qui vicino, in {a}.
Het pakket voor {x} gaat naar {a}, tweede verdieping.
Sinds {d} woon ik dichtbij, namelijk {a}.
Посылка для {x} едет по адресу {a}, второй этаж.
С {d} я живу рядом, вот адрес: {a}.
{a}
I paired with {n} on {t} yesterday.
assigned to {n} since {d}
Thanks to {n} for the fix in {c}!
{n} wrote most of {f} before the handover.
According to {n}, {x} was never finished.
Ask {n} whether {v} is safe.
Laut {n} wurde {x} nie fertig.
{n} hat {f} vor der Übergabe geschrieben.
Frag bitte {n}, ob {v} sicher ist.
Selon {n}, {x} n'a jamais été terminé.
{n} a écrit {f} avant la passation.
Demande à {n} si {v} est sûre.
Según {n}, {x} nunca se terminó.
{n} escribió {f} antes del traspaso.
Pregunta a {n} si {v} es segura.
Segundo {n}, {x} nunca ficou pronto.
{n} escreveu {f} antes da passagem.
Pergunta a {n} se a {v} é segura.
Secondo {n}, {x} non è mai stato finito.
{n} ha scritto {f} prima del passaggio.
Chiedi a {n} se {v} è sicura.
Volgens {n} is {x} nooit afgemaakt.
{n} schreef {f} voor de overdracht.
Vraag {n} of {v} veilig is.
По словам человека по имени {n}, {x} так и не готов.
{f} до передачи писал коллега по имени {n}.
Спроси у человека по имени {n}, готова ли {v}.
-- {n}
-- {n} | {p} | {i}
-- {n} | {a} | {e}
-- {n}; {p}; {i}; {a}
-- {n}; {e}; {i}
-- {n}; {i}
-- {n} | {i}
-- {n} / {i}
-- {n} / {e} / {p} / {i}
-- {n} / {i} / {a}
-- {n}; {p}; {a}
-- {n}; {e}; {p}
-- {n} | {e} | {i}
-- {n} | {e} | {p}
-- {n} / {p} / {a}
-- {n}; {i}; {e}
-- {n}; {p}; {i}
-- {n} | {i} | {a}
-- {n} / {e}
-- {n} | {p}
-- {n}; {a}
-- {n}, tel/mail/id: {e}, tel/mail/id: {p}, tel/mail/id: {i}, tel/mail/id: {a}
-- {n}, tel/mail/id: {p}
-- {n}, tel/mail/id: {i}
-- {n}, tel/mail/id: {a}
run_id={b} {x}
run id {b} of {x} finished after 2718 ms.
[build {b} / {x}]
[build {b} / {x}]
build {b} is green on {x}.
build {b} is green on {x}.
part number {b} is printed on the {x} rack.
10.0.41.17:8082 {d} 04:31
node 10.0.41.17 of {x} was drained {d} 03:12.
trace 4be0179cd2a35f-218 belongs to {t}.
77c0d1e93ab24f-604 {t}
git@code.{s}.example:core/{s}.git#{c}
clone git@code.{s}.example:core/{s}.git and run the {x} smoke test.
pin {s}-client@2.317.1 in {f}.
{s}-client@2.28.1 ({f})
Use @cached on the {x} loader, see {f}.
{S}dale Lane is the code name of lane 27 in the {t} plan.
{S}by Street is the code name of lane 4 in the {t} plan.
{x} needs the old schema before {v} can ship.
What happens to the broken links when {x} restarts?
My suggestion is to rename {x} and keep the duplicate rows for now.
In {t} we decided to drop the cold cache, because two workers wrote the same key.
The backup script dropped from 2718 ms to 314 ms during the review.
We moved two stale branches to {x} after lunch and it took 57 minutes.
If the sync worker fails again, roll back to {v} and tell the {x} group.
The team behind {x} asked for a second copy and the audit list.
Between {d} and today the parser touched 618 records, so I wrote down every step.
Please do not merge {c} yet, unless the numbers get worse.
There is a note in {f} that explains how the export replaces the old index.
After 418 attempts the queue finally accepted the sample files.
I think {x} should own the weekly report, since the cache was never cleared.
V3.14.2 broke the fixtures for 240 users earlier than planned.
{x} braucht das alte Schema, bevor {v} ausgeliefert wird.
Was passiert mit {x}, wenn der Testserver neu startet?
Wir haben die Tabelle nach {x} verschoben, und es dauerte 88 Minuten.
Die Gruppe hinter {x} hat um eine zweite Kopie gebeten.
Ich habe {t} am Wochenende geschlossen, weil niemand die Notizen gepflegt hat.
{x} a besoin de tout cela avant que {v} soit publiée.
Les gens de {x} nous ont demandé une deuxième copie.
Que devient {x} quand le serveur redémarre ?
{x} necesita una segunda copia antes de publicar {v}.
El grupo de {x} nos pidió los enlaces rotos.
Mi propuesta es cambiar el nombre de {x} y mantener dos ramas por ahora.
{x} precisa de tudo isto antes de lançarmos {v}.
O grupo de {x} pediu-nos uma segunda cópia.
{x} ha bisogno di tutto questo prima che esca {v}.
Il gruppo di {x} ci ha chiesto una seconda copia.
{x} heeft een tweede kopie nodig voordat {v} uitkomt.
De groep achter {x} vroeg ons om de dubbele regels.
V3.14.2 broke a smaller batch for 18 users since Monday.
Since Monday, the audit trail lost the summary card, because the clock on one machine drifted.
While everybody was offline, the session cache lost a manual override.
Remember that the query planner is only loaded until the freeze.
Why does {x} still depend on the memory budget from {d}?
Someone copied the missing column into {f} just before midnight.
Nothing in {f} mentions the legacy endpoint, although the logs looked clean.
The summary of {t} says that the review bot and the upload form share the pinned dependency.
It turned out that the login page had been reading the tracing headers from {x}.
We saw 41 warnings about the flaky scenario this morning.
I closed {t} right after the deploy, so that the team can roll back quickly.
I would rather test {x} with the shared fixtures than guess.
Our plan for {x}: fix the slow join, then measure the export job again.
Can you check why the message parser ignores the permission matrix in {f}?
Mein Vorschlag ist, {x} umzubenennen und das Speicherbudget vorerst zu behalten.
Im Dokument {f} wird {x} nicht erwähnt, sodass wir beide Fassungen behalten.
Leider verwirft der Alarmkanal seit Montag kleinere Pakete, während die Anleitung noch etwas anderes sagt.
Das Sicherungsskript brauchte heute früh nur noch 57 statt 4183 Millisekunden.
Der Exportlauf brauchte kurz vor Mitternacht nur noch 314 statt 871 Millisekunden.
Die Warteschlange brauchte nach dem Mittagessen nur noch 9 statt 5620 Millisekunden.
Nach 31 Versuchen hat die Prüfliste endlich die fehlende Spalte angenommen.
Zwischen dem {d} und heute wurden 64 Einträge geändert, da der Anbieter das Format wieder geändert hat.
In {t} haben wir beschlossen, auf {x} zu verzichten, obwohl die Protokolle sauber aussahen.
Ich denke, {x} sollte den Notfallweg übernehmen, damit wir schnell zurückkehren können.
Wenn die Anmeldeseite wieder ausfällt, gehen wir auf {v} zurück.
Es stellte sich heraus, dass der Suchindex die Rechtetabelle aus {x} gelesen hat.
Kannst du bitte prüfen, warum der Zeitplan in {f} nicht mehr läuft?
Bitte {c} noch nicht zusammenführen, weil zwei Dienste denselben Schlüssel schrieben.
In {f} steht ein Hinweis, wie man die Testdaten ersetzt.
Malheureusement, le journal d'audit refuse l'ancien schéma avant la démonstration, sauf si les chiffres se dégradent.
Après 31 essais, la tâche d'export a enfin accepté la table des droits.
Le calendrier est passé de 4183 à 57 millisecondes peu avant minuit.
Nous avons déplacé les exemples partagés vers {x} et cela a pris 314 minutes.
Por desgracia, la lista de control rechaza el plazo más corto esta mañana.
Después de 31 intentos, el calendario por fin aceptó lotes más pequeños.
Infelizmente, o registo de auditoria rejeita a coluna em falta desde segunda-feira.
Depois de 31 tentativas, a fila aceitou finalmente pacotes menores.
Purtroppo la pagina di accesso rifiuta lo schema vecchio da lunedì.
Dopo 31 tentativi il calendario ha finalmente accettato la tabella dei permessi.
Helaas weigert het logboek de oude indeling vlak voor middernacht.
Na 31 pogingen accepteerde de planning eindelijk de kleinere pakketten.
К сожалению, журнал аудита с понедельника отклоняет прежний доступ.
Тестовый бот раньше занимал 4183 миллисекунд, теперь только 57.
Импорт занимал после обеда 871 миллисекунд, теперь только 9.
Nach 5 Versuchen hat der Testserver endlich zwei verwaiste Zweige angenommen.
Diese Umstellung brauchte früher als geplant nur noch 314 statt 4183 Millisekunden.
run_id={b} {x}
Die Steuer-ID {i} gehört nicht in {f}.
Die Steuer-ID {i} gehört nicht in {f}.
O meu número de identificação {i} ainda está em {f}.
El pasaporte {i} no va en {t}.
For the contract use tax id {i}. The login page passes locally.
After 98 attempts our nightly import finally accepted the tracing headers.
After 7 attempts the vector store finally accepted a stricter validator.
For the contract use tax id {i}. By tomorrow evening, the rate limiter lost the summary card.
Fwd: Nothing in {f} mentions the weekly report.
Fwd: Rien dans {f} ne parle de {x}.
Voeg {c} alsjeblieft nog niet samen, dus houden we beide versies.
Merci de ne pas encore fusionner {c}, tandis que la documentation dit autre chose.
Por favor, no fusiones {c} todavía, así que guardamos las dos versiones.
Per favore non unire ancora {c}, quindi teniamo entrambe le versioni.
Por favor, não juntes {c} ainda, por isso guardamos as duas versões.
Пожалуйста, пока не сливайте {c}, поэтому мы храним обе версии.
O calendário desceu de 4183 para 57 milissegundos no fim de semana.
El calendario bajó de 4183 a 571 milisegundos anoche muy tarde.
Il calendario è sceso da 4183 a 57 millisecondi prima della dimostrazione.
De planning ging vlak na de uitrol van 4183 naar 571 milliseconden.
После 31 попыток очередь наконец приняла общие примеры.
Expliqué a {x}; Segundo el registro, nada cambió.
Для {x} нужно подготовить общие примеры, прежде чем выйдет {v}.
Группа {x} попросила у нас вторую копию.
Мы перенесли таблицу в {x} после обеда, и это заняло 57 минут.
Dear {n}, thank you for coming on {d}.
Hi {n}, could you look at the figures again?
Hello {n}! Did the parcel arrive?
Kind regards, {n}
Best, {n}
From: {n}
To: {n} <{e}>
Attendees: {n}, {n}, {n}
Present were {n} and {n}, as well as two guests.
My colleague {n} will join the call at {o}.
I spoke with {n} this morning about the lease.
We met {n} at the station and drove home.
{n} called about invoice {o} and wants a copy.
{n} is on holiday until {d}.
Please ask {n} to sign the form.
Interview with {n}, second round, {d}
The patient {n} was admitted on {d}.
The author of this report is {n}.
Signed by {n} on {d}
Mr. {n} lives at {a}.
Mrs {n} moved out in spring.
Dr. {n} has a free slot on {d}.
The winner of the contest is {n} from the northern district.
Our neighbour {n} has a key.
{n} and {n} disagree about the budget of {o}.
{n} said that the bridge would be closed.
I think {n} was right after all.
This letter was written by {n}.
The account belongs to {n}.
Contact {n} ({p}) for the keys.
Contact: {n}, {p}
Questions? Write to {e} or ring {p}.
Email {e} to get a refund of {o}.
My e-mail is {e}, write any time.
Sent from {e} on {d}
Reply to {e} by {d} please.
You may also contact us through {e}.
I never got your message, try {e} instead.
{n} <{e}> wrote:
Her email address is {e}.
his address: {e}
Subscribe at {e} for news.
The receipt went to {e} last week.
Phone: {p}
Tel. {p}
Tel: {p}
Fax {p}
Cell {p}
Call {p} if the alarm goes off.
Give me a ring on {p} tonight.
You can text {p} at any hour.
His mobile number is {p}.
The hotline {p} is free of charge.
I tried {p} twice and nobody answered.
The reception desk has the number {p}.
Ring {n} at {p} before {d}.
For emergencies use {p} or {p}.
We left a voicemail on {p}.
My SSN is {i}.
SSN: {i}
Her social security number is {i}, keep it safe.
The passport number on the booking is {i}.
Passport: {i}
Driving licence {i} expired on {d}.
His driver's license number is {i}.
Insurance policy holder number {i}
The tax number of the tenant is {i}.
NHS number {i} was missing from the chart.
Please verify the identity card {i} at the desk.
Enter your national insurance number, for example {i}, in the first box.
The applicant with ID number {i} did not appear.
VAT and personal code {i} were printed on the back.
I live at {a}.
We live at {a}, third floor.
The office is at {a}, opposite the bank.
Meet me in front of {a} at {o}.
Address: {a}
Deliver to: {a}
The shop at {a} sells bread.
They bought a house at {a} last year.
Please send the parcel to {a}.
The fire broke out at {a} around midnight.
Parking near {a} costs {o} per hour.
Our new clinic, {a}, opens on {d}.
Turn left and stop at {a}.
The landlord of {a} refused to pay.
Sehr geehrte Frau {n}, vielen Dank für Ihr Schreiben vom {d}.
Lieber {n}, wie geht es dir?
Mit freundlichen Grüßen {n}
Herr {n} hat heute angerufen.
Ich habe gestern {n} getroffen.
Bitte rufen Sie unter {p} zurück.
Telefon: {p}
Handy: {p}
Wir wohnen in der {a}.
Die Praxis befindet sich in der {a} im ersten Stock.
Anschrift: {a}
Meine Personalausweisnummer lautet {i}.
Die Versicherungsnummer {i} steht auf der Karte.
Schreiben Sie uns an {e} oder per Post.
Meine Kollegin {n} übernimmt das am {d}.
Cher {n}, merci pour votre lettre.
Madame {n} habite au {a}.
Nous avons rencontré {n} hier soir.
Appelez le {p} avant midi.
Tél. : {p}
Mon numéro est le {p}.
Écrivez à {e} pour toute question.
Le cabinet se trouve {a}.
Adresse : {a}
Le numéro de sécurité sociale de la patiente est {i}.
Estimado {n}, gracias por su carta.
La señora {n} vive en {a}.
Ayer hablé con {n} sobre el alquiler.
Llame al {p} antes de las {o}.
Tel. de contacto: {p}
Escriba a {e} si tiene dudas.
La tienda está en {a}.
El número de pasaporte es {i}.
Caro {n}, obrigado pela carta.
Falei com {n} sobre a renda.
Ligue para {p} depois das {o}.
Escreva para {e} com as perguntas.
A loja fica na {a}.
O número do passaporte é {i}.
Gentile {n}, grazie della lettera.
Ho incontrato {n} alla stazione.
Chiami il {p} dopo le {o}.
Scriva a {e} per informazioni.
Abito in {a}.
Il numero del passaporto è {i}.
Beste {n}, bedankt voor je brief.
Ik sprak gisteren met {n} over de huur.
Bel {p} als er iets is.
Schrijf naar {e} voor meer informatie.
Wij wonen op {a}.
Het paspoortnummer is {i}.
Уважаемый {n}, спасибо за письмо.
Позвоните по номеру {p} после обеда.
Пишите на {e} по любым вопросам.
Мы живём по адресу {a}.
Серия и номер паспорта: {i}.
Total {o}, paid on {d}.
The order {o} was shipped on {d}.
Page {o} shows the map of the valley.
The temperature fell to {o} during the night.
There were {o} people in the square on {d}.
Chapter {o} explains the rules of the game.
It costs {o} and weighs {o}.
The train leaves at {o} from platform 7.
Section {o}: Terms and Conditions
Next Monday we travel to {S} and then to {S}.
The city of {S} lies on the river {S}.
Welcome to the {S} Museum of Modern Art.
The {S} Company opened a plant in {S}.
University of {S}, Department of History
The {S} Group and {S} Partners signed the contract.
Happy New Year from the whole team!
The Second World War ended in 1945.
North America and South Africa were compared in the study.
In {S}, the Supreme Court decided the case in {o} days.
We watched The {S} Story on Sunday evening.
{S} Airlines cancelled flight {o}.
Read the Terms of Service before {d}.
Release {v} of {S} Server is out.
The {S} Bridge was built in 1932.
Bank of {S}, branch 14
Lake {S} is frozen in January.
On Friday the Finance Committee met in {S}.
Version {v} was tagged by the build bot on {d}.
Score 3-1, attendance {o}.
The meeting room {S} is on floor 4.
Coordinates {o}, {o}
Copy 14 of 250, printed {d}
{n}, {a}, {p}
{n}, {a}
{n}, {e}, {p}
{n} ({e})
{n} ({p}, {e})
Booked for {n} ({e}) until {d}.
Invoice to {n}, {a}, due {d}.
Guests: {n} ({o}), {n} ({o})
Today {n} explained the rules to the children.
Later {n} carried the boxes upstairs.
Then {n} asked a question.
Sometimes {n} plays the piano after dinner.
Captain {n} gave the order at {o}.
Inspector {n} closed the case.
Professor {n} teaches on Tuesdays.
Aunt {n} baked bread.
Everyone was looking for {n} in the garden.
Somebody saw {n} near the lake.
Without {n} the band cannot play.
The bike of {n} was found.
Give it to {n} before lunch.
Ich habe das Auto an {n} verkauft.
Gestern war {n} beim Arzt.
Die Wohnung gehört {n} und der Bank.
J'ai vu {n} au marché.
On a prêté la voiture à {n} pour la semaine.
He vendido el coche a {n} por {o}.
Vi a {n} en la plaza.
Dei as chaves a {n} ontem.
Ho dato le chiavi a {n} ieri.
Ik heb de auto aan {n} verkocht.
The officer noted {i} as the passport number.
The agent typed {i} into the field for the tax id.
We stored {i} instead of the social security number.
Sein Ausweis, {i}, ist abgelaufen.
Son passeport, {i}, a expiré.
Mi pasaporte, {i}, caduca en mayo.
Il suo documento, {i}, è scaduto.
The family rented {a} for the summer.
We walked past {a} and took a picture.
She inherited {a} from her uncle.
Das Haus {a} wird renoviert.
Das Konzert ist in der {a} im Hof.
Die Sitzung findet am {d} im Rathaus statt.
Unsere Preise haben sich geändert.
Die Rechnung vom {d} über {o} ist bezahlt.
Der Zug nach {S} hatte {o} Minuten Verspätung.
Das Museum zeigt Bilder aus dem Norden.
Meine Schwester kauft Brot und Käse auf dem Markt.
Neue Nummer: {p}
Die Nummer der Werkstatt ist {p}.
Der Kurs kostet {o} und beginnt am {d}.
Le train pour {S} part à {o}.
La Banque centrale a publié le rapport.
El Museo Nacional abre a las {o}.
Western {S} and Northern {S} signed a treaty.
Central Asia and West Africa were compared in chapter 12.
Chapter 3 and Figure 14 show the growth of {S}.
Table 2 lists {o} samples from Southern {S}.
The Eastern Railway and the Royal Library were built in 1888.
The Prime Minister and the Foreign Secretary met in {S}.
The Nobel Prize went to two chemists.
Figure 7 compares {S} with {S} in {o} steps.
Yesterday {n} walked home in the rain.
Perhaps {n} forgot the umbrella.
Meanwhile {n} waited at the gate.
Officer {n} wrote the report.
Nobody believed {n} at first.
Nobody knows where {n} went.
The child drew {i} on the paper, which is her social security number.
Text {p} to join.
Text YES to {p} for updates.
Il a rendu la clé à {n} lundi.
Elle a donné le livre à {n} hier.
South {S}, Latin America and Eastern {S} export coffee.
job {b} of {x} ended at {o}
build {b} of {x} passed, see {f}
ticket {t} points to build {b}.
Il n'a pas envie d'acheter {x} cette année.
C'est l'idée de {x}, mais {x} n'y pense plus.
Nous parlons d'installer {x} et d'oublier {x}.
Hablamos de {x} y no de {x} en {t}.
Nadie menciona {x} en el informe.
Het verslag noemt {x} niet.
Falamos de {x} em {t}.
Si parla di {x} nel rapporto.
MAIS {x} N'EST PAS PRÊT.
¿QUÉ DICE EL INFORME DE {x}?
I FORGOT THE DETAILS OF {x} AGAIN.
Upgrade from {v} to {v} before {d}.
{v} fixes the crash and {v} adds the report.
On vient d'installer {x}, puis tout s'est arrêté.
Elle propose d'utiliser {x}, parce que c'est plus simple.
Avant d'ouvrir {x}, lisez {f}.
Malheureusement, l'usine de {S} est fermée depuis {d}.
Personne n'a essayé {x}, même pendant l'été.
Il s'agit d'améliorer {x}, alors nous attendons {v}.
After we moved {x}, nothing worked.
They renamed {x}, so the links broke.
The people of {x}, as always, were late.
Because of {x}, we lost two hours.
Instead of {x}, we used {x}, which was faster.
Wir haben {x}, wie besprochen, abgeschaltet.
Wegen {x}, das alt ist, warten wir noch.
Instalamos {x}, pero nadie lo usa.
Gracias a {x}, todo va mejor.
Graças a {x}, tudo correu bem.
Abbiamo spento {x}, ma nessuno protesta.
We hebben {x}, zoals gezegd, uitgezet.
Из-за {x}, как обычно, всё стоит.
WE STOPPED {x}, AND NOBODY NOTICED.
SIN {x}, NADA FUNCIONA.
PERSONNE NE CONNAÎT {x}, MÊME ICI.
THE REPORT WAS LATE, AS USUAL, BECAUSE OF {x}.
THE NIGHT JOB FAILED AGAIN AFTER LUNCH.
AVANT MIDI NOUS AVONS PERDU LES NOTES.
LAS COPIAS ANTIGUAS SIGUEN EN EL DISCO.
DOPO LA PAUSA NESSUNO HA LETTO IL RAPPORTO.
NA DE PAUZE IS HET RAPPORT NIET GELEZEN.
"""

# Common short forms of given names.
SHORT_FORMS = {
    "alexander": "alex alec sasha xander", "anastasia": "nastya stasia ana", "anthony": "tony ant", "barbara": "babs barb barbie", "benjamin": "ben benny benji",
    "charles": "chuck charlie chas", "christopher": "chris kit topher", "cornelis": "cor kees", "daniel": "dan danny", "deborah": "debbie deb debby", "dmitri": "dima mitya",
    "dorothy": "dot dottie dolly", "edward": "ed eddie ted teddy ned", "ekaterina": "katya katia", "eleanor": "ellie nell nora", "elizabeth": "liz betty beth lizzie eliza bess", "femke": "fem",
    "francesco": "cesco franco ciccio", "franziska": "franzi ziska", "frederick": "fred freddy freddie", "gabriela": "gabi gaby", "giuseppe": "beppe peppe pino", "gregory": "greg",
    "guadalupe": "lupe lupita", "hendrik": "henk rik", "ignacio": "nacho", "jacqueline": "jackie", "james": "jim jimmy jamie", "jennifer": "jen jenny jenn", "johannes": "hannes jan hans",
    "jonathan": "jon jonny", "joseph": "joe joey", "joshua": "josh", "katharine": "kate kathy katie kat", "kenneth": "ken kenny", "lawrence": "larry laurie", "leonard": "len lenny leo",
    "margaret": "peggy maggie meg marge", "matthew": "matt matty", "maximilian": "max", "mercedes": "merche meche", "michael": "mike mick mickey", "mikhail": "misha", "nathaniel": "nat nate nathan",
    "nicholas": "nick nico nicky", "patricia": "pat patty trish tricia", "peter": "pete", "philip": "phil", "rafael": "rafa", "rebecca": "becca becky", "richard": "rich rick dick ricky",
    "robert": "bob bobby rob robbie bert", "samuel": "sam sammy", "sebastian": "seb basti bastian", "stephen": "steve stevie", "susan": "sue susie suzy", "theodore": "ted teddy theo",
    "thomas": "tom tommy", "timothy": "tim timmy", "ulrich": "uli ulli", "valentina": "tina vale valya", "victoria": "vicky tori vic", "vincent": "vince vin", "willem": "wim",
    "william": "bill billy will willy liam", "zachary": "zach zack",
}
