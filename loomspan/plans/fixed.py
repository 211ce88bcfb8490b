"""What the SQL says of its own: patterns, word lists and texts as the survey has them, stated here once more, so that a wrong
value in an operator doesn't pass on both sides."""

from __future__ import annotations

# Fixed values, all of them.
CONVERSATION_STOP_WORDS = (
    "the and that have for not with you this but his from they say her she will one all would there their what out about who get which when make can like "
    "time just him know take people into year your good some could them see other than then now look only come its over think also back after use two how "
    "our work first well way even new want because any these give day most us explain please help"
).split()
TOPIC_STOP_WORDS = (
    "a an the in on at to for of with by from is are was were be been being have has had do does did can could will would should may might i you he she it "
    "we they my your his her what why how when where which who whom explain describe define tell give show help me about example please difference between "
    "versus vs algorithm concept python javascript java c++ code function again work works working mean means meaning occur occurs happen happens use used"
).split()
PHRASES = [('in spite of the fact that', 'although'),
 ('it is important to note that', 'note:'),
 ('due to the fact that', 'because'),
 ('at this point in time', 'now'),
 ('for the purpose of', 'to'),
 ('with respect to', 'regarding'),
 ('in the event that', 'if'),
 ('on the other hand', 'however'),
 ('with regard to', 'regarding'),
 ('a large number of', 'many'),
 ('in addition to', 'besides'),
 ('first and foremost', 'first'),
 ('each and every', 'every'),
 ('in order to', 'to'),
 ('whether or not', 'whether'),
 ('as well as', 'and'),
 ('the fact that', 'that'),
 ('a number of', 'several'),
 ('make sure to', 'ensure'),
 ('be sure to', 'ensure'),
 ('is able to', 'can'),
 ('are able to', 'can'),
 ('was able to', 'could'),
 ('has the ability to', 'can'),
 ('have the ability to', 'can'),
 ('take into account', 'consider'),
 ('take into consideration', 'consider'),
 ('at the present time', 'currently'),
 ('in the near future', 'soon'),
 ('on a regular basis', 'regularly'),
 ('in the process of', 'currently'),
 ('prior to', 'before'),
 ('subsequent to', 'after'),
 ('in close proximity to', 'near'),
 ('a sufficient number of', 'enough'),
 ('in the majority of cases', 'usually'),
 ('can you please explain to me in detail', 'explain'),
 ('can you please explain to me', 'explain'),
 ('could you please explain to me', 'explain'),
 ('can you explain to me', 'explain'),
 ('could you explain to me', 'explain'),
 ('could you help me understand', 'explain'),
 ('can you help me understand', 'explain'),
 ('could you break it down for me', 'explain'),
 ('I really need help understanding', 'help me understand'),
 ('I am really struggling with', 'I struggle with'),
 ('I am really confused about', 'I am confused about'),
 ('I keep getting confused about', 'I am confused about'),
 ('what I am trying to understand is', 'my question:'),
 ('what I want to understand is', 'my question:'),
 ('so basically what I mean is', 'meaning:'),
 ('I was wondering if you could', 'please'),
 ('I was just wondering if', ''),
 ('sorry I pasted that', 'pasted'),
 ('ignore the messy parts', ''),
 ('ignore the repeats', ''),
 ('here is everything I tried', 'my attempts:'),
 ('none of these are working', 'these failed'),
 ('I really need to', 'I need to')]
TOPIC_PREFIXES = ['^(?:can\\s+you\\s+)?(?:please\\s+)?(?:explain|describe|define|tell\\s+me\\s+about)\\s+(?:the\\s+)?(?:concept\\s+of\\s+)?',
 '^(?:what\\s+is|what\\s+are|why\\s+is|why\\s+does|how\\s+does|how\\s+do|how\\s+to)\\s+(?:the\\s+)?',
 '^(?:give\\s+me\\s+an?\\s+example\\s+of)\\s+(?:the\\s+)?']
GREETING = "(?:hi|hello|hey|dear|good\\s+(?:morning|afternoon|evening)|greetings)\\b(?:\\s+(?:professor|prof|teacher|tutor|sir|ma'?am|there|ai|bot|assistant|everyone|friends))?[,!.:;\\-—\\s]*"
PLEASANTRY = "(?iU)^(?:(?:i\\s+)?hope\\s+(?:you\\s+are|you're)\\s+(?:doing\\s+well|having\\s+a\\s+(?:great|good|wonderful|nice)\\s+day|well|good)|i\\s+hope\\s+(?:this\\s+finds\\s+you\\s+well|all\\s+is\\s+well|you\\s+are\\s+well|you're\\s+doing\\s+well))[,!.:;\\s]*"
HEDGES = '\\b(?:basically|sort\\s+of|kind\\s+of|more\\s+or\\s+less)\\b\\s*'
PREAMBLES = ["\\b(?:i\\s+am|i'm)\\s+(?:really\\s+|extremely\\s+|super\\s+|very\\s+)?(?:stressed|anxious|panicking|in\\s+a\\s+state\\s+of\\s+panic|freaking\\s+out|overwhelmed)[^.!?]*?(?:[.!?]|\\band\\b|\\bso\\b|\\bbecause\\b)\\s*",
 '\\b(?:i\\s+really\\s+really\\s+need|i\\s+really\\s+need|i\\s+urgently\\s+need)\\s+(?:your\\s+help|help|assistance|to\\s+understand)[^.!?]*?[.!?]\\s*',
 "\\b(?:i\\s+cannot\\s+understand|i\\s+don't\\s+understand|i\\s+can't\\s+get\\s+my\\s+head\\s+around)\\s+[^.!?]*?[.!?]\\s*",
 "\\b(?:i\\s+am|i'm)\\s+(?:currently\\s+)?(?:preparing|studying)\\s+(?:for\\s+)?(?:my\\s+)?[^.!?]*?(?:midterm|final|exam|test|quiz|interview|class|course|homework|assignment)[^.!?]*?(?:[.!?]|\\band\\b)\\s*",
 "\\b(?:because\\s+)?(?:i\\s+have|i've\\s+got)\\s+(?:my\\s+|an?\\s+)?[^.!?]*?(?:exam|test|quiz|interview|midterm|final|class|deadline)[^.!?]*?(?:tomorrow|today|soon|coming\\s+up|in\\s+an?\\s+hour|morning|next\\s+week)[^.!?]*?(?:[.!?]|\\band\\b)\\s*",
 "\\b(?:i\\s+am|i'm)\\s+(?:a\\s+)?(?:beginner|new|struggling|confused)\\s+(?:at|with|in|to)?\\s*[^.!?]*?\\s*(?:and|so)\\s+",
 "\\b(?:i\\s+am|i'm)\\s+(?:really\\s+)?(?:confused|stuck)\\s+(?:about|on|with)\\s+[^.!?]*?(?:concept|topic|thing)?[,.]*\\s*",
 '\\b(?:as\\s+a\\s+matter\\s+of\\s+fact|to\\s+be\\s+completely\\s+honest|honestly\\s+speaking)[,\\s]+',
 '\\b(?:what\\s+i\\s+(?:really\\s+)?(?:want|need)\\s+to\\s+know\\s+is)\\s+',
 '\\b(?:i\\s+was\\s+wondering\\s+if\\s+you\\s+(?:could|can)\\s+(?:please\\s+)?(?:explain|tell\\s+me))\\s+',
 '\\b(?:could\\s+you\\s+(?:please\\s+)?(?:explain\\s+to\\s+me|tell\\s+me|help\\s+me\\s+understand))\\s+',
 '\\b(?:can\\s+you\\s+(?:please\\s+)?(?:explain\\s+to\\s+me|tell\\s+me|help\\s+me\\s+understand))\\s+',
 '\\b(?:i\\s+really\\s+need\\s+a\\s+clear\\s+explanation\\s+of)\\s+']
SIGNOFF = '(?:thanks\\s+(?:so\\s+much\\s+)?in\\s+advance(?:\\s+for\\s+(?:your\\s+)?help)?|thank\\s+you(?:\\s+(?:so\\s+much|very\\s+much|a\\s+lot))?(?:\\s+in\\s+advance)?(?:\\s+for\\s+(?:your\\s+)?(?:help|time|assistance))?|thanks(?:\\s+(?:so\\s+much|very\\s+much|a\\s+lot))?(?:\\s+in\\s+advance)?|(?:i\\s+)?(?:truly\\s+)?appreciate\\s+(?:everything\\s+you\\s+do|your\\s+help|it)|have\\s+a\\s+(?:great|wonderful|good|nice)\\s+(?:day|rest\\s+of\\s+(?:your\\s+)?day)|please\\s+help(?:\\s+me)?(?:\\s+asap|\\s+soon)?|any\\s+help\\s+(?:would\\s+be|is)\\s+(?:greatly\\s+)?appreciated)'
TRACKING = ['utm_source', 'utm_medium', 'utm_campaign', 'utm_term', 'utm_content', 'fbclid', 'gclid', 'ref_src', 'ref_url', 'yclid', 'mc_cid', 'mc_eid', 'si', 'igshid']
KEY_VALUE = '(?i)(\\b(?:api[_-]?key|secret|token|password)\\s*[:=]\\s*[\'\\"]?)([A-Za-z0-9-_]{16,})([\'\\"]?)'
EMAIL = '\\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}\\b'
PHONE = '(?:\\+?\\d{1,3}[-.\\s]?)?\\(?\\d{3}\\)?[-.\\s]?\\d{3}[-.\\s]?\\d{4}\\b'
DIRECTIVES = {'saving': '[Answer Budget: SAVING]\n'
           'Lead with the direct answer. Max 3 short sections. Code only when it IS the answer. No preamble, no restatement, no closing summary.',
 'critical': '[Answer Budget: CRITICAL]\n'
             'Ultra-compact hint-first response strictly under 60 words. Provide only the essential insight or minimal correction. Zero filler, zero pleasantries.'}
