"""Sentences written apart from the labelled table: other wording, other names, other number forms, none used in training."""


def _s(text, **kinds):
    return text, {(k, v) for k, vs in kinds.items() for v in ([vs] if isinstance(vs, str) else vs)}


SENTENCES = [
    _s("Yesterday Hannah Fitzgerald brought the cake to the picnic.", name="Hannah Fitzgerald"),
    _s("The tickets are in the name of Carmen Ruiz.", name="Carmen Ruiz"),
    _s("Could somebody tell Oluwaseun Adeyemi that the bus is late?", name="Oluwaseun Adeyemi"),
    _s("Many thanks, Priyanka Deshmukh", name="Priyanka Deshmukh"),
    _s("Nobody has seen Walter since the concert.", name="Walter"),
    _s("The keys are with Mrs. Eleanor Whitcombe on the second floor.", name="Eleanor Whitcombe"),
    _s("My dentist, Dr. Sergio Bellini, retires in June.", name="Sergio Bellini"),
    _s("The violin was repaired by K. Nakamura in Osaka.", name="K. Nakamura"),
    _s("Detective Holmes lived at 221B Baker Street for years.", name="Holmes", address="221B Baker Street"),
    _s("The bakery at 12 rue de la Paix closes at noon.", address="12 rue de la Paix"),
    _s("They moved into 48 Willow Crescent before the winter.", address="48 Willow Crescent"),
    _s("The gallery found new rooms at 1450 Mission Street.", address="1450 Mission Street"),
    _s("Our bikes were stolen in front of Lindenstraße 27.", address="Lindenstraße 27"),
    _s("Die Feier findet im Haus Gartenweg 3 statt.", address="Gartenweg 3"),
    _s("La fuga de agua afecta a la Calle Mayor 15.", address="Calle Mayor 15"),
    _s("Het feest is op Prinsengracht 263.", address="Prinsengracht 263"),
    _s("If you find my dog, dial 555-867-5309 at once.", phone="555-867-5309"),
    _s("The plumber answers on (312) 555-0148 until six.", phone="(312) 555-0148"),
    _s("Reservations under +44 20 7946 0018 only.", phone="+44 20 7946 0018"),
    _s("Unsere Nummer hat sich geändert: 0221 4710 815", phone="0221 4710 815"),
    _s("Rappelez-moi au 06 12 34 56 78 ce soir.", phone="06 12 34 56 78"),
    _s("El fontanero contesta en el +34 655 010 203.", phone="+34 655 010 203"),
    _s("Text STOP to 415-555-0117 to leave the list.", phone="415-555-0117"),
    _s("The clerk wrote down 078-05-1120 as the social security number.", idnum="078-05-1120"),
    _s("He lost his passport, number K4471902, on the ferry.", idnum="K4471902"),
    _s("The nurse asked for the insurance number QQ 12 34 56 C twice.", idnum="QQ 12 34 56 C"),
    _s("Her tax identification number is 36 574 261 809.", idnum="36 574 261 809"),
    _s("Su DNI, 53421789R, caduca este año.", idnum="53421789R"),
    _s("Codice fiscale: VRDGPP74B12H501X", idnum="VRDGPP74B12H501X"),
    _s("Photos may be sent to jonas.weber@fotoklub.example until Sunday.", email="jonas.weber@fotoklub.example"),
    _s("Unsubscribe by writing to newsletter@gardenclub.org today.", email="newsletter@gardenclub.org"),
    _s("Ask for the recipe: grandma_rose77@kitchen.co.uk", email="grandma_rose77@kitchen.co.uk"),
    _s("The choir collects donations, see marta (at) choir.example for the account.", email="marta (at) choir.example"),
    _s("Tobias Lindgren, 14 Harbour Lane, +46 8 123 456 78", name="Tobias Lindgren", address="14 Harbour Lane", phone="+46 8 123 456 78"),
    _s("Please bill Aurelia Constantin (aurelia@constantin.example).", name="Aurelia Constantin", email="aurelia@constantin.example"),
    _s("Frau Ingeborg Siebert hat die Schlüssel.", name="Ingeborg Siebert"),
    _s("J'ai rendu le livre à Solène Marchand hier.", name="Solène Marchand"),
    _s("Ik heb Maarten Kuipers al betaald.", name="Maarten Kuipers"),
    _s("O contrato foi assinado por Beatriz Carvalho.", name="Beatriz Carvalho"),
    _s("Il quadro appartiene a Lorenzo Ferrara.", name="Lorenzo Ferrara"),
    _s("The concert starts at 20:15 and tickets cost 35 euros."),
    _s("Flight LH 1748 was delayed by 95 minutes."),
    _s("Chapter 12 compares Eastern Europe with Latin America."),
    _s("Our warranty covers 24 months or 60,000 kilometres."),
    _s("The recipe needs 250 g flour, 3 eggs and 125 ml milk."),
    _s("In 1889 the Eiffel Tower opened to the public."),
    _s("Order 4471-20931 contains two lamps and a chair."),
    _s("The National Gallery shows Dutch paintings until March."),
    _s("ISBN 978-0-13-468599-1 is out of print."),
    _s("The server restarted at 04:17:33 with exit code 137."),
    _s("Use https://example.org/docs/setup.html for the manual."),
    _s("Last Tuesday the Rhine rose by 40 centimetres."),
]

#: Written after the table was finished; nothing in the table answers to these.
LAST = [
    _s("Fatima Al-Sayed will chair the meeting on flood defences.", name="Fatima Al-Sayed"),
    _s("The scholarship went to Nikolai Petrenko from Odessa.", name="Nikolai Petrenko"),
    _s("Our guide, Mr. Desmond Achebe, speaks four languages.", name="Desmond Achebe"),
    _s("Return the drill to Ramona by Friday.", name="Ramona"),
    _s("Every Sunday Gustav Hellström feeds the swans.", name="Gustav Hellström"),
    _s("The piano tuner can be reached at 0049 151 2345 6789.", phone="0049 151 2345 6789"),
    _s("Lost cat! Please ring 617-555-0164.", phone="617-555-0164"),
    _s("The vet's line is +1 (503) 555-0121 on weekdays.", phone="+1 (503) 555-0121"),
    _s("The villa at 7 Chestnut Avenue has a new roof.", address="7 Chestnut Avenue"),
    _s("Das Kind wohnt in der Bahnhofstraße 112.", address="Bahnhofstraße 112"),
    _s("Le plombier passe au 19 avenue de la République.", address="19 avenue de la République"),
    _s("The bank wanted the social security number 433-54-3937 once more.", idnum="433-54-3937"),
    _s("Passport no. L8930217 was found on the beach.", idnum="L8930217"),
    _s("Mail the essay to prof.keller@uni-lakeside.example tonight.", email="prof.keller@uni-lakeside.example"),
    _s("Complaints: complaints+late@busline.example", email="complaints+late@busline.example"),
    _s("La señora Pilar Echeverría vendió su barco.", name="Pilar Echeverría"),
    _s("Sophie Vandenberghe schildert elke dag.", name="Sophie Vandenberghe"),
    _s("Quarter 3 sales rose by 12.4 percent in Northern Europe."),
    _s("The museum owns 4,218 coins from the Roman Empire."),
    _s("Bus 42 leaves every 15 minutes from Central Station."),
    _s("Der Fluss ist 412 Kilometer lang."),
]
