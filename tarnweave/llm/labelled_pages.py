"""Labelled pages of invented sites: the bounded sample that the line classifier of problem 3 is fitted and tested on.

A page is a title, a site's name, a path and its lines. The first sign of a line is its label: `+` is of the main body, `*` too,
but the site repeats it (subheadings of every report, labels of a facts box); `-` is of the frame, `=` too, and the site
repeats it. An empty line is blank.
"""

from __future__ import annotations

#: Title, site, path, lines.
Page = tuple[str, str, str, str]

FIT: list[Page] = [
    ("Council approves new tram line", "Harbour Gazette", "/news/council-approves-new-tram-line", """=Harbour Gazette
=Home | News | Opinion | Sport | Weather | Login
=We value your privacy. This website uses cookies to improve your visit. Accept | Decline

-Home > News > Council approves new tram line
+Council approves new tram line
-By Anna Whitlock, 12 May 2021

+The council approved a new tram line on Tuesday night, after a debate that lasted more than five hours.
+The line will link the old harbour with the university, and it should carry its first passengers in four years.
=Advertisement
+"We have waited for this for a long time," said the mayor, who had asked for the line in her first speech.

+What it will cost

+The city pays about 40 million of the total cost. The rest comes from the state and from a loan that the tram company took out last year.

-Read also: Why the ferry will stop running in autumn
-Tags: trams, council, transport
=Share this: Facebook | Twitter | E-mail
-214 comments. Join the discussion
=More stories
-Ferry will stop running in autumn
-School roof repaired at last (12)
-Harbour market moves to the square
=About | Contact | Imprint | Privacy policy
=© 2021 Harbour Gazette. All rights reserved."""),
    ("Ten easy soups for cold days", "Spoon & Ladle", "/recipes/ten-easy-soups", """=SPOON & LADLE
=Recipes
=Shop
=Videos
=About
=Search
=Skip to content
+Ten easy soups for cold days
-Posted by Marta Lind on 3 November 2019
-5 min read

*Ingredients
+- 200 g red lentils
+- 1 onion, chopped
+- 2 carrots
+- a pinch of salt

*Method
+1. Heat the oil in a large pot and fry the onion until it is soft.
+2. Add the lentils and the carrots, then pour in the stock.
+3. Cook for twenty minutes. Season and serve.

+It keeps for three days in the fridge, and it freezes well.

=Print this recipe   Save   Send to a friend
=You might also like
-Bread without kneading
-The best way to peel garlic
-A cake for every month
=Sign up for our newsletter and get a recipe every week.
=Enter your email address
=Follow us: Instagram - Pinterest
=Made with love in the kitchen
=Copyright 2015-2019 Spoon & Ladle"""),
    ("Results of the third round", "Northern League Site", "/results/round-3", """=Northern League Site - Results
=• Fixtures
=• Results
=• Clubs
=• Forum
=• Register
+Results of the third round
+All games of the third round were played on Sunday, apart from one that was called off because of snow.

+Ashby – Calder 3:1, 2140 spectators
+Moorfield – Stanton 0:0, 871 spectators
+Westbrook – Hale 2:4, 1302 spectators
+Oldcastle – Pym 1:0, 655 spectators
+Ravensworth – Thorne 5:2, 3090 spectators

+Table: Ashby leads with nine points, ahead of Thorne and Hale.

-Next: Preview of the fourth round
-« Previous   1 2 3   Next »
=Report an error
=The opinions of our authors do not always reflect those of the league.
=Contact us | Terms of service | Sitemap
=Hosted by Fastrack Servers"""),
    ("How a steam valve works", "Valve Handbook", "/guides/steam-valve", """=Valve Handbook
=Guides · Parts · Jobs · News
=Sign in
-Guides / Basics / How a steam valve works
+How a steam valve works

*Key facts
+Pressure: 16 bar
+Weight: 4 kg

+A steam valve opens when the pressure in the pipe is higher than the force of its spring.
+Because the spring was tested before the valve was fitted, the engineers could rely on its force, which the maker gives to within one per cent.

+Disc – The part that closes the seat.
+Seat – The ring on which the disc rests.
+Spring – A coil of steel that holds the disc down.

=Article continues after the advertisement
+When the disc lifts, steam escapes and the pressure falls again. Why does it not flutter? The answer lies in the shape of the seat.

-See also: How to choose a gasket
=Did you find this helpful? Tell us
=Download our app for your phone
=Terms and conditions | Accessibility
=Registered in England, company number 114422. Registered office: 4 Mill Street, Leeds
=Back to top"""),
    ("Cheap Garden Sheds Sale", "Old Mill Blog", "/blog/cheap-sheds", """=Old Mill Blog
=Home
=Archive
=Topics
=Members
=Help
-Archive » Blog » A quiet shed in the garden
+Cheap Garden Sheds Sale
-By Tom Rook

+cheap garden sheds
+sheds for sale
+Cheap Garden Sheds
+garden sheds sale
+cheap garden sheds sale
+sheds for sale
+Cheap Garden Sheds
+cheap garden sheds
+garden sheds sale
+sheds for sale

-Tags: garden, shed, wood
=Popular this month:
-Nine small ways to grow a lemon tree
-How we saved the old mill wheel (31)
=This site stores cookies on your computer. By continuing to use it you agree.
=Powered by Quillpress 4.1"""),
    ("Best phone cases", "Trade Corner", "/deals/phone-cases", """=Trade Corner – Deals
=Login | Deals | Brands | Help | Basket
=Go to main content
+Best Cheap Phone Case Discount
-Words: Lena Marsh · 2 March 2020

+cheap phone case best phone case discount phone case cheap case discount best cheap phone case phone case phone case cheap phone case best phone case discount phone case cheap case discount best cheap phone case phone case phone case cheap phone case best phone case discount phone case cheap case discount best cheap phone case phone case phone case

=Save for later   Print   Tell a friend
=Trending
-Seven chargers compared
-Glass or plastic: what lasts longer?
=Prices may change at any time. Errors excepted.
=© Trade Corner 2020"""),
    ("Links for gardeners", "Green Thumb Pages", "/links", """=Green Thumb Pages
=Search | About | Photos | Register
+Online Garden Plant Shop

+https://roses-and-more.example/shop/123
+plant shop - https://plants.example/a/77
+» garden shop (https://seeds.example/b/9)
+https://bulbs.example/c/45
+tree nursery - https://trees.example/d/3
+» garden shop (https://hedges.example/e/8)
+https://lawns.example/f/11
+pots and vases - https://pots.example/g/2

-18 comments
=Follow us on Facebook
=Legal notice | Privacy
=All rights reserved. No part of this site may be copied without permission."""),
    ("The night train", "Paper Boat", "/poems/the-night-train", """=Paper Boat
=Poems   Stories   Essays   Authors
=↓ Start reading
+The night train
-Jon Ashe | 2 min read

+I heard the train go over the hill
+long after the lamps were low
+and someone whistled beyond the mill
+a tune that I used to know

+The river carried it out of sight
+The stars went after it too
+and all the long and empty night
+I thought of the fields and you

-Older post: A letter from the island
=Leave a comment
=Subscribe to new poems by email
=Share on: Twitter · Mail
=Designed by Little Press"""),
    ("Users report a bug in the scheduler", "Kernel Talk", "/threads/scheduler-bug", """=KERNEL TALK
=FORUM
=WIKI
=DOWNLOADS
=CHAT
=LOGIN
-Forum > Threads > Users report a bug in the scheduler
+Users report a bug in the scheduler

+## What happened

+Since the last update the scheduler drops tasks that wait for more than ten seconds.
+```
+run --queue main --limit 10
+exit 3
+```
+Set `limit` to zero and the error goes away. It may come back after a restart.
+> I saw it on two machines as well.
+> It only happens at night.
+Yes. Both of them, and a third one too.

=Reply   Quote   Report
-3 likes, 17 views
=Already a member? Log in to answer.
=Terms | Rules | Contact the moderators
=Powered by TalkBoard 2.2"""),
    ("Museum opens its cellar", "The Vale Post", "/culture/museum-opens-its-cellar", """=The Vale Post – Culture
=Your choice on cookies: necessary, statistics, marketing – Save settings
=[Skip to main part]
=Culture
=Local
=Sport
=Jobs
=Archive
=Latest articles
-Bridge closed for repairs until June
-Farmers ask for rain, and get hail (4)
-Choir looks for tenors
+MUSEUM OPENS ITS CELLAR
-From our correspondent, published 4 July 2018, updated 5 July

+The museum has opened the cellar in which its founders hid the paintings during the war.
-Photo: Vale Post archive
+Visitors can see the wooden racks, the lamps and a diary of the keeper, who shared the cellar with two cats.
=Tap to enlarge
+The copyright in the diary has expired, so the museum will print it next year. Some pages are missing.
+Tickets cost 6 pounds; children go free.

*Opening hours
+Monday: closed
+Tuesday to Friday: 10 to 5

+"Nobody knew," said the keeper's grandson.

-Related: The painter who never sold a picture
=Was this article useful? Yes / No
=Join 4,000 readers: create an account
=Imprint · Data protection · Advertise with us
=(c) 2018 Vale Post Media Ltd"""),
    ("Packing list for the mountains", "High Path", "/tips/packing-list", """=High Path
=<li><a href="/routes">Routes</a></li>
=<li><a href="/huts">Huts</a></li>
=<li><a href="/shop">Shop</a></li>
=<nav><a href="/">Start</a> <a href="/about">About us</a></nav>
+Packing list for the mountains
-by Iris Holm, 2022-06-01

+<p>A light pack makes a long day short. What do you really need?</p>
+<ul>
+<li>two pairs of socks</li>
+<li>a map that does not need a battery</li>
+<li>a warm hat</li>
+</ul>
+<h2>What can stay at home</h2>
+<p>Leave the second jumper, the third book &amp; the camping chair.</p>
+* a heavy towel
+* tins

-Up next – Five huts with a view
=Share   Tweet   Pin
-Written by Iris Holm, who walks wherever the path goes.
=About us: High Path was founded in 1998 by three friends who liked maps.
=Feeds   Newsletter   Sitemap"""),
    ("Stolen bicycle returned", "Market Town Times", "/local/stolen-bicycle-returned", """=MARKET TOWN TIMES
=News - Local - Sport - Letters - Subscribe
+Stolen bicycle returned
-Market Town Times, 9 September 2017

+A bicycle that was stolen in 1987 has been returned to its owner.
+It stood in front of her house on Friday morning, with new tyres and a note.
=Scroll down to continue
+"Sorry," it said.
+The owner, who is now 71, said that she would ride it again. "Why not?" she asked.
+Share a bench with her and she will tell you the rest.

+The police have closed the file.

=Most viewed
-Fire at the bakery: nobody hurt
-Twelve kittens look for a home
-New timetable from Monday
-Letters: The clock is wrong again
=Get the app: scan the code
=Send us your story
=Views expressed by columnists are their own.
=Market Town Times is a member of the Press Council."""),
    ("Understanding interest rates", "Plain Money", "/learn/interest-rates", """=Plain Money | Learn
=Learn · Compare · Tools · Advisers
=Open menu
-You are here: Learn / Basics / Understanding interest rates
+Understanding interest rates
-Reviewed by: P. Okafor – last updated 11 January 2023

*In short
+Although interest rates were raised twice, most savers in the region considered them a poor return on their money, because prices had risen faster.

*The details
+An important reason for this is that banks, which had been cautious before, no longer compete for deposits.
+- A rate is the price of money.
+- It is given in per cent a year.
+The committee discussed several proposals, including a lower rate for small firms.
+Formula: interest = sum × rate × years.

=Not what you were looking for? Ask us
=Recommended for you
-What is a bond?
-How to read your pension letter
=By clicking "I agree" you allow us to remember your choices. Manage cookies
=Privacy | Cookies | Complaints
=Plain Money Ltd is authorised and regulated. Company no. 99210"""),
    ("Old words of the coast", "Dialect Notes", "/words/coast", """=Dialect Notes
=Words
=Sounds
=Maps
=Guestbook
+Old words of the coast

+A short list of words that fishermen used, with what they meant.

+brim: the edge of a net
+cadge: to ask for a lift in a boat
+fleet: a row of nets
+gant: to yawn
+haaf: the deep sea
+skerry: a rock that the tide covers

+Most of them are gone. A few live on in songs, which the children learn without knowing what they say.

-← Previous: Words of the mill
-→ Next: Words of the moor
=Print page
=Sign our guestbook
=Last modified: 4 August 2014
=Made in Whitby"""),
    ("Top sofa tags", "Home Style Hub", "/tags/sofa", """=Home Style Hub – Shop
=Start | Sofas | Tables | Lamps | Sale
-Start / Sofas / A sofa for a small room
+Buy New Sofa Table Outlet
-Posted by Ed Pike, 2021-04-30

+red sofa xl, blue table set, oak chair new, small lamp pack of 2, grey sofa size 4, round table white, tall shelf black, soft pillow set, long bench new, wide stool red, green rug size 9, flat lamp white, old chest set, low couch pack of 3, deep armchair xl, thin curtain grey

+#sofa #table #cheapsofa #sofa #lamp #cheapsofa #oakchair #sofa #rug

=SHARE  88
=Editor's picks
-Nine lamps under fifty
=Returns | Delivery | Contact
=Prices include VAT. Subject to change."""),
    ("Storm damage on the pier", "Coastline Radio", "/2016/storm-damage", """=Coastline Radio
=On air now: The Morning Show
=Listen live
=News / Music / Presenters / Win
+Storm damage on the pier

+The pier lost thirty metres of railing in the storm on Sunday. Nobody was hurt.
+Engineers checked the posts on Monday; two of them must be replaced before the season begins.
+Each post weighs a ton, and each costs about 900 crowns. The harbour master had asked for them last year, but the money went into the lighthouse.
+The pier opened in 1894 and was widened in 1931.

+In numbers
+Railing: 30 m
+Posts: 2

+* Story sent in by listeners *

-More from News: Lighthouse painted red again
=Text the studio: 80011
-Comments (7)
=Cookie settings
=Complaints | Jobs | Frequencies
=© Coastline Radio Group 2016. Reproduction in whole or part is prohibited."""),
    ("Letter to the editor", "Harbour Gazette", "/letters/noise", """=Harbour Gazette – Letters
=Home | News | Opinion | Sport | Weather | Login
+Letter to the editor: Noise

+Sir,
+the noise of the new fans is too much. I cannot sleep, and neither can my neighbours.
+We have written to the firm twice. They answered once, with a leaflet.
+Please print this, so that they read it at least there.

+Yours
+R. Tanner, Mill Lane

=Write to us: letters@harbour-gazette.example
=More stories
-Tram line: what the residents say
-Fans must be quieter, says court
=About | Contact | Imprint | Privacy policy
=© 2019 Harbour Gazette. All rights reserved."""),
    ("Flat roofs in wet regions", "Builders' Wiki", "/wiki/flat-roofs", """=Builders' Wiki
=Main page · Recent changes · Random page · Help
=Jump to navigation
+Flat roofs in wet regions
+A '''flat roof''' is a roof with a slope of less than ten degrees. It is common in dry regions and, since the [[1950s]], in wet ones too.
+== History ==
+The first flat roofs in the north leaked within two winters.{{cn}} Builders then turned to tar, later to sheets of rubber.
+== Materials ==
+{| class="wikitable"
+! Material !! Years
+|-
+| Tar || 15
+| Rubber || 40
+|}
+[[Category:Roofs]]
=This page was last changed on 3 June 2012, at 10:14.
=Text is available under a free licence.
=Edit   History   Talk
=Privacy policy   About Builders' Wiki   Disclaimers"""),
    ("Lost in the marsh", "Two Rivers Stories", "/stories/lost-in-the-marsh", """=two rivers stories
=stories
=authors
=submit
=donate
+Lost in the marsh
-a story by K. Brandt

+They had been told to follow the posts. When the fog came, there were no posts.
+"This way," said Edda.
+"No."
+"Then where?"
+He did not know, and he did not say so. Somewhere a dog barked twice and stopped.

+* * *

+In the morning they stood on the road, which had been twenty steps away all night.

-Read the next story: The ferryman's daughter
=Support us: buy us a coffee
=Stay in touch: newsletter | feed
=© the authors"""),
    ("Rivers of the plain", "School Atlas Online", "/atlas/rivers", """=School Atlas Online
=Maps
=Countries
=Quiz
=Teachers
=Log in
-Maps > Europe > Rivers of the plain
+Rivers of the plain

*At a glance
+Length: 410 km
+Mouth: the bay of Orr

+The river rises in the hills of the south and crosses the plain in wide loops. Ships use it from April to November.
+According to fishermen, the state of the river depends on the weirs, on the rain in spring, and on the farms along its banks. Is it clean? In most years it is.

*Learn more
+The delta is home to herons, otters and a small kind of pike. Between 1950 and now, half of it was drained.
+Visit it in May, when the storks are back.

=Test yourself: take the quiz
=Popular maps
-The Alps in ten maps
-Deserts of the world
=Report a mistake on this page
=Cookies help us deliver our services. OK | Learn more
=Contact   Licences   Accessibility statement"""),
    ("Methods", "Preprint Shelf", "/papers/441", """=Preprint Shelf
=Browse | Submit | Help | Sign in
=Search papers
+Growth of moss on roofs
-A. Smit, B. Orlov – submitted 4 April 2020

+\\section{Methods}
+We measured the moss on 40 roofs, twice a year, and \\emph{fitted} a line to the logarithm of its weight.
+\\begin{itemize}
+\\item roofs of clay
+\\item roofs of slate
+\\end{itemize}
+$$ w = a e^{bt} $$
+Here $a$ is the weight at the start, and $b$ the rate of growth, see~\\ref{tab:one}.
+\\section{Results}
+Moss grew faster on clay, as others had found. [^3]

=Download PDF
-Cited by 12
=Export citation
=Terms of use · Privacy · Status"""),
    ("Heat pumps in old houses", "House Doctor", "/advice/heat-pumps", """=HOUSE DOCTOR
=Advice  Prices  Tradesmen  Tools
=Sponsored
+Heat pumps in old houses
-House Doctor team · 4 minute read

*What you should know
+Can a heat pump warm an old house? Often it can, if the walls are dry.
+Our tester lived with one for two winters and wrote down what it used.
+January: 610 kWh
+February: 540 kWh
+March: 400 kWh
=This is a paid placement
+The fan is quiet, but it is not silent. “You hear it at night,” he says.
+The grant pays up to $5 of every $20 spent.

-Don't miss: Which grant pays for what
-See all articles about heating
=Compare prices now
=Get three quotes from tradesmen near you
=We may earn money when you click on links.
=Help | Press | Careers | Legal"""),
    ("Cable Motor Offers", "Workshop Weekly", "/w/cable-motor", """=WORKSHOP WEEKLY
=Guides
=Machines
=Classifieds
=About
+Free Heavy Cable Motor Offers

+free heavy cable in Barrow
+free heavy cable in Ludlow today
+free heavy cable in Selby and near you
+free heavy cable in Whitby!!!
+free heavy cable in Kendal
+free heavy cable in Malton today
+free heavy cable in Barrow and near you
+free heavy cable in Otley!!!
+free heavy cable in Ripon

=Tags and topics
=Discuss this article in our forum
=Workshop Weekly was first printed in 1971 for men who mended tractors.
=Impressum | AGB | Datenschutz"""),
    ("Quiet Wool Deals", "Knit Circle", "/k/quiet-wool", """=Knit Circle | Patterns
=Patterns | Yarn | Groups | Shop
+Top Quiet Wool Yarn Deals

+Soft merino yarn
+Thick wool blanket
+Blue cotton thread
+Warm alpaca scarf
+Light linen ribbon
+Rough hemp cord
+Grey wool sock
+Fine silk shawl
+Broad felt hat
+Long cotton sleeve
+Round wooden button
+Old brass needle

-31 people like this
=Join the group
=Knit Circle – all about wool
=Contact   Terms"""),
    ("Interview with a beekeeper", "Valley Voices", "/interviews/beekeeper", """=Valley Voices
=Listen
=Read
=Take part
=Donate
-Read > Interviews > Interview with a beekeeper
+Interview with a beekeeper
-Text: Rosa Klein, photos: Ben Ode

+How many hives do you have?
+Forty, in a good year.
+And in a bad one?
+Twelve. We lost the rest to mites, and nobody could tell us why it was so many.

+Is honey still worth the work?
+It is never about the money. You go out in the morning, and they are up before you.

+Wax and smoke

+She lights the smoker with a bit of old sack. It works better than paper, she says, since it burns so slowly.

=Like what you read? Become a member
-Previous interview: The last bell founder
-All interviews
=Valley Voices is funded by its listeners and by the county.
=Our newsletter: once a month, no adverts
=Imprint, privacy, contact"""),
    ("Short notes", "Daily Byte", "/notes/31", """=Daily Byte
=Notes / Reviews / Podcast
+Short notes
-31 August

+The new release fixes the clock.
+Search works again.
+Cookies are now deleted when the window closes, as they should have been from the start.

=Next note
=Reply by mail
=RSS"""),
    ("A walk along the old canal", "Towpath News", "/walks/a-walk-along-the-old-canal", """=Towpath News
=Walks
=Boats
=Locks
=Events
=Start / Walks
-Start » Walks » A walk along the old canal
=Latest walks
-Three short rounds near Selby
-How volunteers cleared the north bank
-The quiet reservoir of Hessle (17)
-Lock gates lifted in Barnby after frost
+A walk along the old canal
-By Hugh Marr

*OVERVIEW
+Distance: 9 km

+Start at the basin, where the boats turn. Was it always this calm? Hardly.
=ADVERTISEMENT – keep scrolling
+"The water is low," said Marr, who keeps the second lock. In June, 14 boats waited for rain.

*What to bring
+1 flask of tea
+2. 2 sandwiches from the basin shop
+3 apples
+- 1 map

-Tags: canals, locks, quiet walks
-58 comments. Add yours
=SHARE 112
=Towpath News was founded in 1979 by people who repaired lock gates.
=Registered charity no. 20231"""),
    ("Seven small ways to keep a pan clean", "Hearth and Home", "/tips/seven-small-ways-to-keep-a-pan-clean-2231.html", """=HEARTH AND HOME
=Tips · Tools · Forum
=Login
-Tips > Kitchen / Seven small ways to keep a pan clean
+Seven small ways to keep a pan clean
-Eva Strand | 6 min read

+A pan costs about 80 crowns, rarely less than a pot. Look after it.
+#3 on our list: the wire brush.
+Salt: a rough kind of sand.
=Story continues after the picture
+When the pan met the acid, it turned grey. Because it had been oiled before the soup was cooked, it could be saved.
-Read also – How cooks chose the heavy lid
=Click to zoom
+Yes. The lid, the pan and the handle = 31.

+Notes

+Share the oil with two pans and keep the rest dark.

-← Previous: Old oven, new door: a report from Hull
-Next up: Dough saved in York after warm night
=Print   Save for later   Report a problem
=Enter your e-mail to get one tip a week
=Prices were correct when this was written; errors and omissions excepted."""),
    ("Guitar stolen in Bath after late concert", "String Review", "/local/guitar-stolen-in-bath-after-late-concert", """=String Review – Local
=<li><a href="/local">Local</a></li>
=<li><a href="/concerts">Concerts</a></li>
=<li><a href="/search">Search</a></li>
=<li><a href="/contact">Contact</a></li>
-Local / Guitar stolen in Bath after late concert
+Guitar stolen in Bath after late concert
-Words: Colin Fry · 17 March 2021

*Good to know
+Guitars: 12

+The guitar disappeared between the concert and the morning. Nobody had locked the stage door.
+<p>It is a small one, with a cracked neck.</p>
+Police asked the public for help. The privacy of witnesses, they said, was safe.

+The search

-Further reading: Violin found in a hedge
+They looked in the pond, in the mill and under the stage.

=Popular today
-Fifteen small ways to tune a piano
-Old flute, young player: a report from Wells
=Get String Review on your phone
=We and our 310 partners process your data to show adverts. Manage options
=Terms of use | Privacy | Imprint | Accessibility"""),
    ("Cheap Lamp Shop Reviews", "Corner Post", "/reviews/how-readers-chose-the-quiet-lamp", """=Corner Post
=Register | Archive | Guides | About
-Guides / Reviews » How readers chose the quiet lamp
=Trending topics
-Lamp lost in Dover after long trip (9)
-HOW GUESTS PAINTED THE OLD HALL
+Cheap Lamp Shop Reviews
-Posted by Ned Hollis, 2020-11-08

+lamp shop | cheap lamp | lamp shop reviews | cheap lamp | lamp shop | cheap lamp shop | lamp shop reviews | cheap lamp | lamp shop | cheap lamp | lamp shop reviews | lamp shop | cheap lamp shop | lamp shop | cheap lamp | lamp shop reviews | cheap lamp

-Tags: lamps, halls, slow trains
-640 comments. Join in
=You can follow us here: Chatter - Snapbox
=Back to the top ↑"""),
    ("Five teams, one field", "Village Sport", "/reports/five-teams-one-field", """=Village Sport
=Reports   Tables   Players   Shop
-Reports > Football > Five teams, one field
+Five teams, one field
-Text: Olga Penn · 2 June 2019

*The short version
+Each team has one goal; the field has two.

+Ardley – Bourne 1:1, 212 neighbours watched
+Corby – Deeping 4:0, 95 neighbours watched
+Ealand – Ardley 2:3, 180 children watched

=Continue reading below
+Between 2011 and now, the field was mown twice. When the referee asked for a line, farmers drew one with flour.

*What comes next
+In autumn.

-See also: Pitch flooded in Corby after heavy rain
-Up next – How players shared one shirt
=Did you enjoy this? Pass it on (77 shares)
=About us: Four farmers marked the first field in 1960, because the cows had left it.
=Made in Deeping
=© 2019 Village Sport. All rights reserved."""),
    ("Glossary of weaving", "Loom Letters", "/glossary/weaving", """=LOOM LETTERS
=• Letters
=• Looms
=• MEMBERS
=• Photos
=[Go to the text]
+Glossary of weaving
-by Tess Arden, 12 min read

*Reading
+The words are old, but the looms are older.

+Heddle – In most looms, a wire with an eye that lifts one thread.
+Reed – A comb that beats the weft, often of steel.
+Shed – The gap through which the shuttle flies.
+Weft – Weavers carry it across the warp, row by row.

=Anzeige
+Warp, weft and reed: that is all you need.

-Related letters: Wool dyed in Kelso after dry summer
-11 replies
=Get our letters by post. Subscribe here
=Loom Letters – small looms from Kelso
=Opinions are those of the writers and not those of Loom Letters.
=Contact | Legal | Cookies"""),
    ("Public Sensor Valve Deals", "Pump Station", "/p/sensor", """=Pump Station | News
=News | Pumps | Valves | Jobs | Help | Photos
=Your privacy is important. Only essential cookies? Yes / No
+Public Sensor Valve Deals

+They bought it in May, because the old valve had rusted. In Leeds, 20 engineers tested the new one.
+public sensor valve deals sensor valve public sensor valve deals valve deals public sensor sensor valve deals public sensor valve deals sensor valve public sensor valve deals valve deals public sensor sensor valve deals public sensor valve deals
+The valve sealed the pipe near Leeds last year.

=Most read
-Pump moved in Hull after cold spring
-Four new ways to keep a valve dry (6)
=By staying on this page you accept small files on your device.
=Sitemap   Feeds   Advertising"""),
    ("The lighthouse keeper's list", "Coast Diary", "/diary/the-lighthouse-keepers-list", """=Coast Diary
=Diary
=Weather
=Boats
=Help
=Sign up
-Diary / 1911 / The lighthouse keeper's list
+The lighthouse keeper's list

+He wrote it in the winter of 1911, and it hung in the lamp room until the light went out.

*Key figures
+Lamp: 1
+Steps: 214

+12 kg white paint, opened
+3 l lamp oil, spilled
+40 m new rope, tarred
+7 brass screws, lost

-Photo: Coast Diary
+[[File:Lamp.jpg|thumb|The lamp]]
+> The night was loud. I did not sleep.

+Although the boat was late, most keepers thought the food was good enough.

-Older: Ship aground off Filey
=Already subscribed? Log in to read the whole diary.
=Sponsored links
-Holiday flats by the sea
-Ropes, chains, anchors
=Press Ctrl+P to print
=Privacy notice"""),
    ("Parish minutes", "Lower Ditton Online", "/minutes/may", """=Lower Ditton Online
=Parish | Church | School | Hall | Contact
+Parish minutes, May

+1. Apologies
+None.
+2. Hedge in Mill Lane
+It will be cut in August. Mrs Dale asked for September, since birds nest in it.
+3. Money
+Balance: 1,204.50
+Spent: 88.10
+4. Any other business
+The clock is slow. Mr Hay will look at it.

=Documents and downloads
-Minutes of April
-Minutes of March
=Website by Ditton Design
=Last updated: 14 May 2020"""),
    ("Clear skies over the observatory", "Star Gazette", "/sky/clear-skies-over-the-observatory", """=star gazette
=sky   moon   planets   shop
=Jump to the article
=Notice: we use cookies for statistics. Agree / Settings
-sky > nights > Clear skies over the observatory
+Clear skies over the observatory
-Author: Milo Grant, 30 August 2018

+The <b>observatory</b> opened its roof for the first time since June. What did the guests see? Saturn, mostly.
+According to astronomers, the view depends on the wind, on the moon and on the street lamps of the town.
+Set mirror_angle = 12 and look in C:\\sky\\logs.
=Article continues below this advertisement
+The R&D budget was $12 to $15 for each lens.
+<!-- block -->Seven telescopes stood on the lawn; a child broke one.

+Questions

+Will it open again? It will, if the money lasts.

-You might also read: Comet seen in Truro after storm
-Previous post: Eclipse, part two
=Follow us: Chatter, Snapbox, Pixroll
=Scan this code with your camera
=Star Gazette Publishing, 14 Hill Road, Truro. Company number 8812
=Up ↑"""),
    ("Bright Oven Tray Outlet", "Baker's Board", "/b/tray", """=BAKER'S BOARD
=Bread
=Cakes
=Board
=Login
-Board > Trays > How bakers chose the flat tray
+Bright Oven Tray Outlet
-Ines Vale | 1 min read

+#brightoventray #oven #flour #brightoventray #tray #oldoven #brightoventray #cake #rye #brightoventray #oven #whitetray #brightoventray #tray

=Like this? Share it (41 shares)
=Board rules | Terms | Imprint"""),
    ("Small Clock Spring Price", "Tick Tock Times", "/t/spring", """=Tick Tock Times
=Watches · Clocks · Repair · Contact
+Small Clock Spring Price

+small clock spring for wall clock price small clock spring and old clock price small clock spring with key clock price small clock spring of brass clock price small clock spring for wall clock price small clock spring and old clock price

-Next: The tower clock of Wells
=Newsletter: leave your address
=Tick Tock Times, a journal for slow people"""),
    ("Why bridges hum", "Engineers' Corner", "/why/why-bridges-hum", """=Engineers' Corner – Why?
=Why? | How? | Who? | Search
-Why? » Structures » Why bridges hum
+WHY BRIDGES HUM
-Posted on 8 May 2015 by admin

+Wind makes cables swing. If it blows evenly, the cable finds a tone and keeps it, as a string does.
+1. The wind divides at the cable.
+2. Small eddies leave it, left and right by turns.
+3. The cable swings with them.
+The bridge at Oresby hums in F. Its engineers, who had expected silence, recorded it and sold the record.

+Can it be stopped?

+A thin wire around the cable is enough.

-Filed under: bridges, sound
-Posted in Structures | 4 Comments »
=Leave a comment
=Recent posts
-Why doors squeak
-Why roofs are red
=Archives
-May 2015
-April 2015
=Proudly powered by Inkwell
=RSS feed"""),
    ("Council minutes leak", "Riverside Record", "/politics/council-minutes-leak", """=RIVERSIDE RECORD
=World | Politics | Business | Culture | More
=Subscribe | Sign in | Search
-World / Politics / Council minutes leak
+Council minutes leak

-Anna Berg, political editor
-Tue 3 Mar 2020 06.00 GMT

+A copy of the minutes was found on a bus on Monday. It was wet, but it could be read.
+The minutes show that the council had talked about a new bridge for a year without telling anyone.
=Sign up to our morning briefing
+“It was a draft,” said the clerk.
=View image in fullscreen
-The bus on which the minutes were found. Photograph: R. Record

+The opposition called for a vote. It lost.

=Topics
-Local government
-Buses
-Bridges
=Reuse this content
=Most commented
-Bus seats to be dried
=Help us to stay independent: support the Record from one pound
=Contact us | Complaints | Modern slavery statement | Digital archive"""),
    ("Turnip prices", "Market Board", "/prices/turnips", """=Market Board
=Prices
=Traders
=Map
-Prices - Roots - Turnip prices
+Turnip prices

*Today
+Turnips: 0.80
+Swedes: 1.10
+Parsnips: 2.00

+Prices rose, since it froze again. Traders expect more of it.

*How we measure
+We ask nine traders at noon and take the middle price.

=Print this page
=Data may be late by a day. Use at your own risk.
=Market Board is a service of the county"""),
    ("How farmers saved the long hedge", "Field Notes Weekly", "/fields/how-farmers-saved-the-long-hedge", """=FIELD NOTES WEEKLY
=Fields
=Barns
=Weather
=Help
-Fields / Hedges / How farmers saved the long hedge
=Popular this week
-Barn rebuilt in Alston after wet autumn (33)
-The cold spring of Hexham
-Six simple ways to keep a fence straight
-Old plough, new field: a report from Ripley (8)
-How shepherds counted the lost flock
+How farmers saved the long hedge
-Nora Field | 5 min read

+Weeds and wire

+The hedge was planted in 1820, and nobody had cut it since the war. “It was a wall,” said the oldest of them.
=Advertisement
+Because it stood between two farms, neither owner felt that it was theirs.
=Sponsored
+They met in spring, counted the gaps and filled them with hawthorn.
=Advert – continue scrolling
+Was it worth it? The birds think so.

+1 spade from Alston
+- 3 young hawthorns
+4. 2 rolls of twine
+* 1 ladder

-Next: The barn owl of Ripley
-88 comments. Start a discussion
=More from Field Notes Weekly
-Nine useful ways to keep a barn dry (52)
-Small pond, loud frogs: a report from Skelton
-Ripley and its quiet market
-Gate painted in Hexham after long row (4)
-How neighbours measured the shared ditch
=Write to us
=Field Notes Weekly – good soil since 1954
=Copyright 1998-2020 Field Notes Media"""),
    ("The broken clock of Morley", "North Street Journal", "/city/the-broken-clock-of-morley-889.html", """=North Street Journal – City
=City · Arts · Food · Jobs
=Skip to main text
-City » Towers » The broken clock of Morley
+The broken clock of Morley
-Posted by Gwen Tully, 2021-09-30

*The essentials
+Clock: 1738

+Each tower has a clock; the one of Morley has two, and both are wrong.
=Advert
+The council asked a watchmaker, who asked for a ladder.
=Continues below
+“Slow,” he said.

+Springs and wheels

=Article continues after advert
+Although the wheels were cleaned twice, most people in Morley thought that the bell was late.

-Related stories: Bell cast in Otley after second try
=Sign up for the evening letter
=Latest stories
-The yellow door of Pudsey (12)
-How tenants painted the narrow stair
-Three recent ways to keep a roof warm
-Otley and its long bridge
-Tram stopped in Pudsey after small fire (70)
-Blue tiles, grey sky: a report from Morley
=Corrections   Print   Save
=The views of our guests are not those of the Journal.
=Registered office: 1 North Street, Morley. Company no. 5501"""),
    ("Rain tested in Kirkby after dry June", "Weather Watchers", "/w/rain-tested-in-kirkby-after-dry-june", """=Weather Watchers
=<li><a href="/rain">Rain</a></li>
=<li><a href="/wind">Wind</a></li>
=<li><a href="/forum">Forum</a></li>
=<li><a href="/login">Login</a></li>
-Rain > Kirkby > Rain tested in Kirkby after dry June
=Trending today
-The wet cellar of Formby
-How sailors read the low clouds (19)
-Eight sharp ways to keep a gauge clean
-Storm, calm: a report from Maghull (3)
+Rain tested in Kirkby after dry June
-By Alan Speke

*Summary
+According to watchers, the state of the gauge depends on the wind and on the birds that sit on it.
=(Advertisement)
+Compared with the old gauge, whose glass was cracked, the new one offers twice the scale.

+Rain: 12
+Wind: 3

-Read on – How gulls broke the wind vane
+In Formby, 9 watchers wrote down the same number.

+Questions and answers

+“It rained,” said Speke.

-Tags: rain, gauges, dry June
=Tap the picture to enlarge
=Share this page: Mail | Chatter | Print
=You may also like
-Hail in Bootle, and no umbrella
-Fog lifted in Crosby after noon (44)
-The warm wall of Aintree
-How children drew the north wind
-Two gauges, one tap: a report from Litherland
=What others read
-Snow measured in Huyton after long wait
-Thunder: a short history
=Follow Weather Watchers
=© 2020 Weather Watchers. All rights reserved."""),
    ("Good knives, bad boards", "Tool Talk", "/t/good-knives-bad-boards", """=TOOL TALK | Knives
=Knives | Boards | Stones | Shop
=Trending
-Blade lost in Thirsk after market day
-How cooks tested the thin blade
-The heavy board of Masham (5)
-Five late ways to keep a stone flat
+Good knives, bad boards

+A board costs more than people think, and lasts longer if it is wood.
=Sponsored content
+Nobody oiled the board, but the knife was sharp and new.

+Oh the board, the heavy old board,
+it cracked when the winter was done
+and nobody asked for the reason why
+they lit it and sat in the sun

=Ad – story continues
+Oil it twice a year. Why not today?

=Recommended
-Stone turned in Bedale after cold bath
-Knife, fork: a report from Leyburn (91)
-How guests cut the last loaf
-Masham and its small forge
-Ten clean ways to keep a handle dry
-The public oven of Thirsk
-Old steel, new edge (6)
=Terms | Cookies | About Tool Talk
=Powered by Anvil 7"""),
    ("Quiet pumps for small wells", "Well Diggers", "/q/quiet-pumps-for-small-wells", """=Well Diggers
=Start
=Pumps
=Pipes
=Members
-Start > Pumps » Quiet pumps for small wells
+Quiet pumps for small wells
-Words: Ida Stroud · 5 May 2017

*What you will need
+![pump](img/pump.png)
+A pump, a pipe and a neighbour who knows how deep the water lies.

*In brief
+{{Infobox pump|name=Small|depth=9}}
+The pump lifts nine metres. $$p \\leq 9$$
+[[Category:Pumps of the north]]

-Related: Well dug in Ludlow after third try
-« Older: Pipes in frost
=Members only: log in to see prices
=Read next
-How diggers heard the deep water
-The long pipe of Clun (14)
-Four firm ways to keep a well covered
-Rope, bucket: a report from Knighton
=Back up
=Well Diggers was founded in 1988 by members who dug their own."""),
    ("Online Heavy Parcel Price", "Parcel People", "/pp/heavy", """=PARCEL PEOPLE – NEWS
=News | Rates | Tracking | Jobs
=Accept cookies? All / Only necessary
=Most viewed today
-Parcel found in Goole after two years
-How drivers sorted the wet boxes (7)
+Online Heavy Parcel Price

+heavy parcel price
+online heavy parcel
+heavy parcel price
+Online Heavy Parcel
+parcel price
+heavy parcel price
+online heavy parcel
+parcel price
+Online Heavy Parcel
+heavy parcel price
+parcel price
+online heavy parcel

-Next: Van stopped in Selby after loud bang
-7 comments. Join the debate
=Popular right now
-The small stamp of Drax
-Box, tape: a report from Snaith (20)
=Parcel People, 3 Dock Lane, Goole"""),
    ("Buy Modern Sofa Fabric Reviews", "Fabric Forum", "/ff/how-weavers-dyed-the-old-cloth", """=Fabric Forum
=Forum · Looms · Shops
-Forum > Cloth > How weavers dyed the old cloth
+Buy Modern Sofa Fabric Reviews
-By Leo Hatch

+https://cloth-one.example:443/dye/11
+silk thread - https://cloth-two.example:443/red/7
+» fabric reviews (https://cloth-three.example:443/b/41)
+» fabric reviews (https://cloth-four.example:443/c/3)
+https://cloth-five.example:443/new/9
+wool felt - https://cloth-six.example:443/old/2
+https://cloth-seven.example:443/dry/8

-Tags: cloth, dye, old looms
=Forum rules | Contact
=Hot topics
-Linen bleached in Colne after rain
-The torn sail of Nelson (2)
-How tailors lost the last button
=Fabric Forum does not answer for what members write."""),
    ("Slow roads of the fens", "Fen Traveller", "/roads/slow-roads-of-the-fens", """=Fen Traveller
=Roads | Inns | Maps | Letters
-Roads / Fens / Slow roads of the fens
+Slow roads of the fens
-By Owen Reed

*Good to know
+Roads: 14

+The roads are straight, but they sink. Nobody hurries here, and few could.

=Advertisement
+Dykes and drains

+Each dyke has a keeper; the keeper has a boat. In March, 40 travellers asked the way.

=Article continues below
+1. 2 maps of the fens
+- 3 warm coats
+2 lanterns

=(Sponsored)
+Inns

+Between Ely and the sea there are four. Why so few? The beer is good in all of them.

=Article continues below

-Older post: The ferry at Denver
=Tell a friend
=© Fen Traveller"""),
    ("Bread, salt and water", "Crumb", "/c/bread-salt-and-water", """=CRUMB
=Loaves
=Rolls
=Ovens
=Latest posts
-Rye proved in Bonn after warm evening
-The quiet oven of Kassel
-How bakers weighed the grey dough (8)
+Bread, salt and water
-Words: Jutta Kern · 1 July 2020

*Our verdict

+It is bread, and the crust cracks. What more is there?
=Scroll to continue with content
+450 g flour
+10 g salt
+300 g water

=Advert
+The crust

+When the oven met the steam, the crust shone. Bakers opened it late, because they were asleep.

=Sponsored
+loaf: what comes out
+heel: its end

-Tags: bread, salt
=Join 900 bakers"""),
    ("Two mills and a weir", "River Pages", "/r/two-mills-and-a-weir", """=River Pages
=• Mills
=• Weirs
=• Join
=Popular this week
-Weir mended in Ross after flood
-Fish, ladder: a report from Hay (2)
-The deep pool of Wye
+Two mills and a weir
-Ann Lowe | 2 min read

*Key facts

+Two mills stand at one weir, and they share its water by the hour.
=Tap to enlarge
+Notes

+The upper mill has it by night. The lower mill, whose wheel is larger, has it by day.
=Story continues after this picture
+a wheel of oak
+a wheel of iron

+They have never been at court.

=Comments are closed
=River Pages – quiet water since 2001"""),
    ("The ferry that never sailed", "Quay Papers", "/ferry", """=Quay Papers
=Home | Ships | Ports
+The ferry that never sailed

+The ferry was built in 1911, and it has stood in the yard ever since. Nobody knows who ordered it.
+It has forty seats.

=Related articles
-The tug in the garden
-A mast for the church
-Ships of stone

=Copyright 2014 Quay Papers
=To the top"""),
    ("Apples in winter", "Orchard Mail", "/apples", """=Orchard Mail
=Home | Trees | Fruit | Contact
+Apples in winter

+Store them in straw, and turn them once a week. They keep until Easter if the cellar is cold.

+What they need

+- dry air
+- a dark room

=Related posts
-Pears are not apples
-The best straw
=Recent comments
-Ada on Pears are not apples
-Tom on The best straw"""),
    ("A bell for the harbour", "Bell & Tower", "/bell", """=Bell & Tower
+A bell for the harbour

+The bell weighs two tons. It came by boat, since no cart would hold it, and it rang once on the way.

=Related stories
-The silent tower of Deal
-Ropes and ringers
=More articles
-Casting in winter
-A crack in the treble
=Copyright Bell & Tower 2018"""),
    ("", "Spare Parts Index", "/index/7", """+brake lever left side for old hill bicycle
+brake lever right side for old hill bicycle
+chain guard black for touring bicycle with bell
+front lamp small with two clips and cable
+front lamp large with two clips and cable
+hub gear three speed for ladies bicycle
+hub gear five speed for ladies bicycle
+inner tube wide valve for cargo bicycle
+mud guard steel pair for town bicycle
+pedal rubber left or right for town bicycle
+rear lamp round with wire for dynamo
+saddle brown leather with springs and bolts
+spoke set long for front wheel of racer
+spoke set short for rear wheel of racer
+tyre repair box with glue and six patches"""),
    ("", "Names", "/boats", """+Adela of Whitby
+Blue Heron
+Camel
+Good Hope
+Ida and Ben
+Northern Maid
+Perseverance
+Old Tom
+Three Sisters
+Water Rail
+Zephyr"""),
    ("", "Plain", "/plain.txt", """+He came at noon and left at four.
+In between, he said nothing that anyone could remember.

+The dog followed him to the gate.
+Nobody else did."""),
    ("", "Cheap Things", "/x", """=Home
=News
=Forum
=Login
=Help
+cheap toy train cheap toy train set toy train sale cheap toy train cheap toy train set toy train sale cheap toy train cheap toy train set toy train sale cheap toy train cheap toy train set toy train sale cheap toy train cheap toy train set toy train sale
=Contact
=Imprint
=Terms"""),
]

#: Pages that the classifier is not fitted on, for the figures of precision and recall.
HELD_OUT: list[Page] = [
    ("School gets a new library", "Fen Courier", "/education/school-gets-a-new-library", """=Fen Courier – Education
=News | Sport | Farming | Education | Letters | Sign in
=This website uses cookies. Read our cookie policy. Accept all | Reject
-News > Education > School gets a new library
+School gets a new library
-By Paul Reeve, 4 October 2020

+The school in Fenwick has a new library. It was paid for by parents, who had collected money for three years.
=Story continues below
+Pupils carried the books from the old building themselves. One of them, a biography of a sailor, had been out on loan since 1974.
+“Nobody will be fined,” said the head teacher.

*The facts
+Books: 4,200
+Seats: 36

-Tags: schools, books, parents
=Share: Mail | Print
=Most read
-Flood wall holds, just (3)
-Tractor parade on Saturday
=Terms of use | Privacy | Contact
=Copyright 2020 Fen Courier Ltd"""),
    ("Pancakes", "Quick Kitchen", "/pancakes", """=QUICK KITCHEN
=• Recipes
=• Tips
=• Shop
+Pancakes
-Posted by Jo, 2 Feb 2018

+They are done in ten minutes and gone in five.

+250 g flour
+2 eggs
+300 ml milk

+Beat the eggs, add the milk and the flour. Let it rest while the pan gets hot.
+Fry them on both sides.

-Next: Waffles
=Print   Save
=You may also enjoy
-Omelette with herbs
-Toast, but better
=Get our recipes by email: subscribe
=Powered by Kitchenware 3"""),
    ("Discount Paint Brush Price", "Colour Notes", "/c/brush", """=Colour Notes
=Home
=Forum
=Photos
=Contact
+Discount Paint Brush Price
-By Rita Moss

+discount paint brush paint brush price discount paint brush paint brush price brush price discount paint paint brush price discount paint brush discount paint brush paint brush price discount paint brush paint brush price brush price discount paint

=Trending this week
-How to clean a brush
=Back to top ↑
=© 2022 Colour Notes"""),
    ("Rounds and songs", "Choir Book", "/songs/rounds", """=Choir Book
=Songs · Scores · Concerts · Members
+Rounds and songs

+Row on, row on, the night is long
+the lantern burns below
+and none will hear the boatman's song
+but those who had to go

+Alto – The lower of the two voices of women.
+Canon – A piece in which one voice follows another.
+Tenor – A high voice of men.

-Older entries
=Leave a reply
=Choir Book is run by volunteers.
=Imprint"""),
    ("Table of tides", "Port Info", "/tides", """=Port Info - Tides
=Start
=Tides
=Webcam
=Berths
-Start / Tides / Table of tides
+Table of tides

+High water comes about fifty minutes later each day. Check the board at the lock before you leave.

+Monday 04:12 3.1 m
+Tuesday 05:01 3.3 m
+Wednesday 05:52 3.4 m
+Thursday 06:40 3.2 m

+The harbour master answers questions until six.

=Subscribe to storm warnings
=Cookie preferences
=All times are local. No liability is accepted for errors."""),
    ("Linen Curtain Shop", "Window World", "/ww/linen", """=Window World | Blog
=Blog | Shop | Stores | Login
+Online Linen Curtain Shop

+linen shop - https://linen.example/1
+https://curtains.example/2
+» curtain shop (https://blinds.example/3)
+https://windows.example/4
+rod shop - https://rods.example/5

=Follow us on Instagram
-12 shares
=Delivery | Returns | Legal notice"""),
    ("Why ice is slippery", "Ask a Physicist", "/q/ice", """=Ask a Physicist
=Questions
=Answers
=Ask
=Log in
+Why ice is slippery
-Answered by Dr. Lee · 3 min read

+Ice is covered by a very thin layer of water, even below zero. Skates glide on it.
+It was long believed that pressure melts the ice, but a person is too light for that.

+A simple test

+Put a coin on an ice cube and wait. What do you see? Privacy of the coin aside, not much.

-Related: Why does hot water freeze?
=Was this helpful? Yes | No
=Ask your own question
=Imprint | Data protection"""),
]
