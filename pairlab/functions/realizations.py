"""The realisation pattern table of the slot-error check.

Per slot either a list of verbatim values (``name``, ``near``) or, per value, a list
of regex alternatives.  Every alternative is wrapped in word boundaries and the
alternatives of one value are tried as one case-insensitive regex.  The patterns
are kept verbatim, typos included (``(:?good``, ``(?: the)(?:kids``), because they
decide which phrases count as realisations.  Order matters: slots and values are
scanned in this order and ties are settled in it.
"""

REALIZATIONS = {
    'area': {
        'city centre': [
            '(?:city|town) cent(?:re|er)',
            'cent(?:re|er) of (?:the )?(?:city|town)',
            'in the cent(?:re|er)',
        ],
        'riverside': [
            'riverside',
            '(?:near|by|at|close to|along|on|off|beside) the river',
        ],
    },
    'eat_type': {
        'coffee shop': [
            'coffee[- ]+shop',
            'caf[eé]',
            'coffee',
        ],
        'pub': [
            'pub',
        ],
        'restaurant': [
            'restaurant',
        ],
    },
    'family_friendly': {
        'no': [
            '(?:isn\'t|not|non|no)[ -]+(?:\\w+ ){0,2}(?:child|children|family|kids|kid)[ -]+(?:friendly|orien(?:ta)?ted)',
            '(?:child|children|family|kids|kid)[ -]+unfriendly',
            'adults?[ -]+only',
            'only for adults',
            '(?:no|not) (?:kids|children|famil(?:y|ies))',
            '(?:not|no)(?: good| suitable| friendly| orien(?:ta)?ted| open(?:ed))? (?:at|for|to|with)(?: the)? (?:kids|children|family|families|all age)',
            '(?:kids?|child(?:ren)?|famil(?:y|ies)) (?:are|is)(?:n\'t| not) (?:welcome|allowed|accepted)',
            '(?:does not|doesn\'t) (?:welcome|allow|accept) (?:\\w+ ){0,2}(?:kids?|child(?:ren)?|famil(?:y|ies)|all age)',
            'adult (?:establishment|venue|place|establish)',
        ],
        'yes': [
            'for (?:kids|children|family|families)',
            'family place',
            'place to bring the(?: whole)? family',
            '(?:friendly|suitable|good|orien(?:ta)?ted|open(?:ed)) (?:at|with|to|for)(?: the)(?:kids?|child(?:ren)?|famil(?:y|ies)?|all age)',
            '(?:child|children|family|kids|kid)[ -]+(?:friendly|orien(?:ta)?ted)',
            '(?:kids?|child(?:ren)?|famil(?:y|ies)) (?:are|is) (?:welcome|allowed|accepted)',
            '(?:welcomes?|allows?|accepts?) (?:\\w+ ){0,2}(?:kids?|child(?:ren)?|famil(?:y|ies)|all age)',
        ],
    },
    'food': {
        'Chinese': ['Chinese', 'Chines'],
        'English': ['English', 'British'],
        'Fast food': ['Fast food'],
        'French': ['French'],
        'Indian': ['Indian'],
        'Italian': ['Italian'],
        'Japanese': ['Japanese'],
    },
    'name': [
        'Alimentum', 'Aromi', 'Bibimbap House', 'Blue Spice', 'Browns Cambridge', 'Clowns',
        'Cocum', 'Cotto', 'Fitzbillies', 'Giraffe', 'Green Man', 'Loch Fyne', 'Midsummer House',
        'Strada', 'Taste of Cambridge', 'The Cambridge Blue', 'The Cricketers', 'The Dumpling Tree',
        'The Eagle', 'The Golden Curry', 'The Golden Palace', 'The Mill', 'The Olive Grove',
        'The Phoenix', 'The Plough', 'The Punter', 'The Rice Boat', 'The Twenty Two', 'The Vaults',
        'The Waterman', 'The Wrestlers', 'Travellers Rest Beefeater', 'Wildwood', 'Zizzi',
    ],
    'near': [
        'All Bar One', 'Avalon', 'Burger King', 'Café Adriatic', 'Café Brazil', 'Café Rouge',
        'Café Sicilia', 'Clare Hall', 'Crowne Plaza Hotel', 'Express by Holiday Inn',
        'Rainbow Vegetarian Café', 'Raja Indian Cuisine', 'Ranch', 'The Bakers',
        'The Portland Arms', 'The Rice Boat', 'The Six Bells', 'The Sorrento', 'Yippee Noodle Bar',
    ],
    'price_range': {
        "cheap": [
            "(?:inexpensive|cheap)(?:ly)?",
            "low[- ]+price[ds]?",
            "affordabl[ey]",
            "prices?(?: range)?(?: \\w+){0,3} low",
        ],
        "less than £20": [
            "(?:inexpensive|cheap)(?:ly)?",
            "affordabl[ey]",
            "(?:less than|under) £? *20",
            "moderately priced",
            "low[- ]+price[ds]?",
            "prices?(?: range)?(?: \\w+){0,3} low",
        ],
        "more than £30": [
            "(?:more than|over) £? *30",
            "high[- ]+price[ds]?",
            "expensive",
            "not cheap",
            "prices?(?: range)?(?: \\w+){0,3} high",
        ],
        "high": [
            "high[- ]+price[ds]?",
            "expensive",
            "prices?(?: range)?(?: \\w+){0,3} high",
        ],
        "moderate": [
            "(?:moderate|reasonable|ok|average)(?:ly)?[- ]+price[ds]?",
            "not cheap",
            "affordable",
            "mid[- ]+(?:range[- ]+)price[ds]?",
            "prices?(?: range)?(?: \\w+){0,3} (?:ok|average|moderate|reasonable)",
        ],
        "£20-25": [
            "£? *20 *(?:[-–]*|to) *25",
            "(?:moderate|reasonable|ok|average)(?:ly)?[- ]+price[ds]?",
            "prices?(?: range)?(?: \\w+){0,3} (?:ok|average|moderate|reasonable)",
            "affordable",
        ]
    },
    'rating': {
        "1 out of 5": [
            "(?:1|one)(?:(?: out)? of (?:5|five)(?: stars?)?|[- ]+stars?)",
            "(?:rat(?:ings?|e[ds]?)|reviews?|standards?|quality)(?: \\w+){0,2} (?:as )?(?:low|bad|poor)(?:(?: \\w+){0,3} (?:1|one)(?:(?: out)? of (?:5|five)|[- ]+stars?))?",
            "(?:low|bad|poor|(?:not|doesn't|isn't)(?: \\w+){0,2} (:?good|well))(?:ly)?(?:[ -]+\\w+){0,2}[ -]+(?:rat(?:ings?|ed)|reviews?|standards?|quality)(?:(?: \\w+){0,3} (?:1|one)(?:(?: out)? of (?:5|five)(?: stars?)?|[- ]+stars?))?",
        ],
        "3 out of 5": [
            "(?:3|three)(?:(?: out)? of (?:5|five)(?: stars?)?|[- ]+stars?)",
            "(?:rat(?:ings?|e[ds]?)|reviews?|standards?|quality)(?: \\w+){0,2} (?:as )?average(?:(?: \\w+){0,3} (?:3|three)(?:(?: out)? of (?:5|five)|[- ]+stars?))?",
            "(?:average|(?<!very )(?:good|well))(?:ly)?(?:[ -]+\\w+){0,2}[ -]+(?:rat(?:ings?|ed)|reviews?|standards?|quality)(?:(?: \\w+){0,3} (?:3|three)(?:(?: out)? of (?:5|five)(?: stars?)?|[- ]+stars?))?",
        ],
        "5 out of 5": [
            "(?:5|five)(?:(?: out)? of (?:5|five)(?: stars?)?|[- ]+stars?)",
            "(?:rat(?:ings?|e[ds]?)|reviews?|standards?|quality)(?: \\w+){0,2} (?:as )?high(?:(?: \\w+){0,3} (?:5|five)(?:(?: out)? of (?:5|five)|[- ]+stars?))?",
            "(?:high|excellent|very good|great)(?:ly)?(?:[ -]+\\w+){0,2}[ -]+(?:rat(?:ings?|ed)|reviews?|standards?|quality)(?:(?: \\w+){0,3} (?:5|five)(?:(?: out)? of (?:5|five)(?: stars?)?|[- ]+stars?))?",
        ],
        "high": [
            "(?:5|five)(?:(?: out)? of (?:5|five)(?: stars?)?|[- ]+stars?)",
            "(?:rat(?:ings?|e[ds]?)|reviews?|standards?|quality)(?: \\w+){0,2} (?:as )?high",
            "(?:high|excellent|very good|great|well)(?:ly)?(?:[ -]+\\w+){0,2}[ -]+(?:rat(?:ings?|ed)|reviews?|standards?|quality)",
        ],
        "average": [
            "(?:3|three)(?:(?: out)? of (?:5|five)(?: stars?)?|[- ]+stars?)",
            "(?:rat(?:ings?|e[ds]?)|reviews?|standards?|quality)(?: \\w+){0,2} (?:as )?average",
            "(?:average|(?<!very )(?:good|well))(?:ly)?(?:[ -]+\\w+){0,2}[ -]+(?:rat(?:ings?|ed)|reviews?|standards?|quality)",
        ],
        "low": [
            "(?:1|one)(?:(?: out)? of (?:5|five)(?: stars?)?|[- ]+stars?)",
            "(?:rat(?:ings?|e[ds]?)|reviews?|standards?|quality)(?: \\w+){0,2} (?:as )?(?:low|bad|poor)",
            "(?:low|bad|poor|(?:not|doesn't|isn't)(?: \\w+){0,2} (?:well|good))(?:ly)?(?:[ -]+\\w+){0,2}[ -]+(?:rat(?:ings?|ed)|reviews?|standards?|quality)",
        ],
    },
}
