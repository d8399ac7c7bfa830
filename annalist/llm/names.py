"""Given names, the default of the surrogates' table: (name, gender). Names that also begin sentences often (Will, May,
Hope) are left out; a table of one's own may hold them."""

from __future__ import annotations

# Fixed values.
_F = """
Abigail Ada Adele Adriana Agatha Agnes Agnieszka Aisha Alejandra Alessandra Alexandra Alice Alicia Alison Allison Amanda Amelia Amina Amy Ana Anastasia
Andrea Angela Angelica Angelina Anita Ann Anna Anne Annette Annika Antonia Antoinette Aoife Ariana Astrid Audrey Aurora Ava Ayesha Barbara
Beatrice Beatriz Becky Bella Bernadette Bernice Beth Bethany Betty Beverly Bianca Birgit Bonnie Brenda Bridget Brigitte Britta Camila Camille Candice
Carla Carmen Carol Caroline Carolyn Cassandra Catalina Catarina Catherine Cathy Cecilia Celeste Celine Chantal Charlene Charlotte Chelsea Cheryl Chiara
Chloe Christa Christiane Christina Christine Cindy Claire Clara Claudia Colleen Connie Consuelo Cornelia Courtney Cristina Cynthia Dagmar Dana Daniela
Danielle Daria Deborah Debra Delphine Denise Diana Diane Dolores Dominique Donna Dora Doris Dorothea Dorothy Ebony Edith Edna Eileen Elaine Eleanor
Elena Elisa Elisabeth Elise Eliza Elizabeth Ella Ellen Elsa Elsie Emilia Emily Emma Erica Erika Erin Esmeralda Estelle Esther Ethel Eugenia Eva Evelyn
Fatima Felicia Fernanda Fiona Flora Frances Francesca Franziska Frieda Gabriela Gabriele Gabrielle Gemma Genevieve Georgina Geraldine Gerda Gertrude
Gina Giovanna Gisela Giulia Gladys Gloria Greta Guadalupe Gudrun Gwen Hannah Harriet Hazel Heather Heidi Heike Helen Helena Helene Helga Henrietta Hilda
Hildegard Hillary Ida Ilse Imogen Ines Inge Ingrid Irene Irina Irma Isabel Isabella Isabelle Ivana Jacqueline Jane Janet Janice Jasmine Jeanette Jeanne
Jennifer Jenny Jessica Jill Joan Joanna Joanne Jocelyn Johanna Josephine Joyce Juana Juanita Judith Judy Julia Juliana Julie Juliet Juliette Jutta Karen
Karin Karina Karla Katarzyna Kate Katharina Katherine Kathleen Kathryn Kathy Katie Katja Katrin Kayla Kelly Kerstin Kim Kimberly Kirsten Kristen Kristin
Kristina Lara Larissa Latoya Laura Lauren Laurie Leah Leila Lena Leonie Leticia Lillian Linda Lindsay Lisa Lois Lorena Loretta Lori Lorraine Louise Lucia
Luciana Lucie Lucille Lucinda Lucy Luisa Luise Lydia Lynn Mabel Madeleine Madison Magdalena Maggie Malgorzata Manuela Marcella Marcia Margaret Margarete
Margarita Margot Marguerite Maria Mariana Marianne Marie Marilyn Marina Marion Marissa Marjorie Marlene Marta Martha Martina Mary Mathilde Matilda Maureen
Maxine Megan Melanie Melinda Melissa Meredith Michele Michelle Mildred Miranda Miriam Molly Monica Monika Monique Muriel Myra Nadia Nadine Nancy Naomi
Natalia Natalie Natasha Nicola Nicole Nina Noemi Nora Norma Olga Olivia Pamela Patricia Paula Pauline Peggy Petra Philippa Phoebe Phyllis Pilar Polina
Priscilla Priya Rachel Ramona Raquel Rebecca Regina Renate Renee Rhonda Rita Roberta Rocio Rosa Rosalie Rosalind Rosario Rosemarie Rosemary Roxanne Ruth
Sabine Sabrina Sally Samantha Sandra Sara Sarah Saskia Selina Shannon Sharon Sheila Shirley Sigrid Silke Silvia Simone Sofia Solange Sonia Sonja Sophia
Sophie Stacey Stefanie Stella Stephanie Susan Susana Susanna Susanne Suzanne Svetlana Sylvia Sylvie Tabea Tamara Tanya Tara Tatiana Teresa Theresa Therese
Tiffany Tina Tracy Trudy Ulrike Ursula Uta Valentina Valeria Valerie Vanessa Vera Verena Veronica Veronika Veronique Victoria Vivian Vivienne Waltraud
Wanda Wendy Wilhelmina Winifred Ximena Yasmin Yolanda Yvette Yvonne Zainab Zoe Zofia
Adèle Agnès Amélie Andréa Ángela Anaïs Begoña Béatrice Cécile Chloé Élise Élodie Émilie Françoise Geneviève Hélène Inés Irène Joséphine Lucía María
Mónica Noémie Renée Sofía Thérèse Valérie Verónica Véronique Zoé
"""
_M = """
Aaron Abdul Abdullah Abraham Adam Adolf Adrian Ahmad Ahmed Alan Albert Alberto Alejandro Alessandro Alex Alexander Alexandre Alexei Alfonso Alfred Alfredo
Ali Alistair Allan Allen Alvaro Alvin Amir Anders Andre Andreas Andrew Andrzej Andy Anthony Anton Antonio Armando Arnold Arthur Arturo Axel Barry Bartosz
Bashir Ben Benedikt Benjamin Bernard Bernd Bernhard Bill Bob Bobby Boris Brad Bradley Brandon Brendan Brett Brian Bruce Bruno Bryan Caleb Calvin Cameron
Carl Carlos Cedric Cesar Charles Charlie Chris Christoph Christophe Christopher Clarence Claude Claudio Clement Clifford Clinton Clyde Colin Connor
Constantin Corey Craig Curtis Cyril Damian Dan Daniel Daniele Danny Darren Darryl Dave David Dennis Derek Dermot Desmond Detlef Diego Dieter Dietrich Dimitri
Dirk Dmitri Dominic Dominik Don Donald Douglas Duncan Dustin Dylan Earl Eberhard Eddie Edgar Edmund Eduardo Edward Edwin Egon Elias Elijah Elliot Emil
Emilio Emmanuel Enrico Enrique Eric Erich Erik Ernest Ernesto Ernst Ethan Etienne Eugene Evan Fabian Fabio Felipe Felix Ferdinand Fernando Filip Florian
Floyd Francesco Francis Francisco Franck Frank Franklin Franz Fred Frederic Frederick Fritz Friedrich Gabriel Gareth Garrett Gary Gavin Geoffrey George
Georg Gerald Gerard Gerardo Gerhard Gilbert Giorgio Giovanni Giuseppe Glenn Gordon Graham Greg Gregor Gregory Guido Guillaume Guillermo Gunther Gustav
Gustavo Hamid Hamza Hans Harald Harold Harry Hartmut Harvey Hassan Hector Heinrich Heinz Helmut Hendrik Henri Henrik Henry Herbert Hermann Howard Hubert Hugh
Hugo Hussein Ian Ibrahim Ignacio Igor Ingo Isaac Ismail Ivan Jack Jackson Jacob Jacques Jaime Jakob James Jamie Jan Jared Jason Javier Jean Jeff Jeffrey
Jens Jeremiah Jeremy Jerome Jerry Jesse Jim Jimmy Joachim Joaquin Joe Joel Johann Johannes John Johnny Jon Jonas Jonathan Jorge Jose Josef Joseph Joshua
Juan Juergen Julian Julien Julio Julius Justin Kai Karl Karsten Keith Ken Kenneth Kevin Khalid Klaus Konrad Krzysztof Kurt Kyle Larry Lars Laurence Laurent
Lawrence Lee Leo Leon Leonard Leonardo Leroy Leslie Lewis Liam Lloyd Logan Lorenzo Lothar Louis Luca Lucas Ludwig Luigi Luis Lukas Luke Luther Mahmoud
Malcolm Manfred Manuel Marc Marcel Marcin Marco Marcos Marcus Mariano Mario Marius Mark Markus Marshall Martin Marvin Massimo Mathieu Mats Matteo Matthew
Matthias Maurice Mauricio Max Maximilian Melvin Michael Michal Michel Miguel Mike Mikhail Milan Mitchell Mohamed Mohammad Mohammed Moritz Moses Muhammad
Mustafa Nathan Nathaniel Neil Nicholas Nick Nicolas Nigel Niklas Nikolai Nikolaus Noah Noel Norbert Norman Olaf Oleg Oliver Olivier Omar Oscar Oskar Otto
Owen Pablo Paolo Pascal Patrick Paul Paulo Pavel Pedro Peter Phil Philip Philipp Philippe Phillip Pierre Piotr Rafael Rainer Ralf Ralph Ramon Randall Randy
Raul Raymond Reginald Reinhard Ricardo Richard Rick Ricky Rob Robert Roberto Rodney Rodrigo Roger Roland Rolf Roman Ron Ronald Ronnie Rory Ross Roy Rudolf
Rupert Russell Ryan Salvador Salvatore Sam Samuel Scott Sean Sebastian Serge Sergei Sergio Seth Shane Shaun Siegfried Silvio Simon Stanley Stefan Stephan
Stephane Stephen Steve Steven Stuart Sven Sylvain Tariq Ted Terence Terrence Terry Theo Theodor Theodore Thierry Thomas Thorsten Tim Timothy Tobias Todd
Tom Tomas Tomasz Tommy Tony Travis Trevor Tyler Ulrich Umberto Uwe Vernon Viktor Vincent Vincenzo Vladimir Volker Wade Walter Warren Wayne Werner Wesley
Wilfried Wilhelm Willem William Willy Winston Wojciech Wolfgang Xavier Yann Yusuf Yves Yuri Zachary Zbigniew
Adrián Álvaro Andrés Ángel César Clément Cédric Étienne François Frédéric Gérard Germán Günter Günther Héctor Hervé Iñaki Iván Jérôme Jesús Joaquín José
Jörg Julián Jürgen Léon Mathéo Martín Óscar Raúl René Rubén Sébastien Stéphane Tomás Víctor
"""
_CYRILLIC_F = """
Александра Алена Алина Алиса Алла Анастасия Ангелина Анна Валентина Валерия Варвара Василиса Вера Вероника Виктория Галина Дарья Диана Евгения Екатерина
Елена Елизавета Жанна Зинаида Зоя Инна Ирина Капитолина Карина Кира Клавдия Ксения Лариса Лидия Людмила Маргарита Марина Мария Надежда Наталия Наталья
Нина Оксана Ольга Полина Раиса Римма Светлана София Софья Тамара Татьяна Ульяна Элина Юлия Яна
"""
_CYRILLIC_M = """
Александр Алексей Анатолий Андрей Антон Аркадий Артём Артем Артур Богдан Борис Вадим Валентин Валерий Василий Виктор Виталий Владимир Владислав Всеволод
Вячеслав Геннадий Георгий Герман Григорий Даниил Денис Дмитрий Евгений Егор Иван Игорь Илья Кирилл Константин Лев Леонид Максим Марат Матвей Михаил
Никита Николай Олег Павел Пётр Петр Роман Руслан Семён Семен Сергей Станислав Степан Тимофей Тимур Фёдор Федор Филипп Эдуард Юрий Ярослав
"""
_GREEK_F = """
Αγγελική Αθανασία Αικατερίνη Αλεξάνδρα Αναστασία Άννα Βασιλική Γεωργία Δέσποινα Δήμητρα Ειρήνη Ελένη Ελευθερία Ευαγγελία Ευγενία Ζωή Θεοδώρα Ιωάννα
Κατερίνα Κωνσταντίνα Μαρία Μαρίνα Παναγιώτα Παρασκευή Σοφία Σταυρούλα Στέλλα Χριστίνα Χρυσούλα
"""
_GREEK_M = """
Αθανάσιος Αλέξανδρος Αλέξης Ανδρέας Αντώνης Αντώνιος Απόστολος Βασίλειος Βασίλης Γεώργιος Γιάννης Γιώργος Δημήτρης Δημήτριος Ευάγγελος Ηλίας Θεόδωρος
Ιωάννης Κυριάκος Κώστας Κωνσταντίνος Λεωνίδας Μιχαήλ Νικόλαος Νίκος Παναγιώτης Παύλος Πέτρος Σπυρίδων Σταύρος Στέφανος Χαράλαμπος Χρήστος
"""
ROWS: tuple[tuple[str, str], ...] = tuple(sorted(
    {(n, g) for g, lists in (("f", (_F, _CYRILLIC_F, _GREEK_F)), ("m", (_M, _CYRILLIC_M, _GREEK_M))) for names in lists for n in names.split()}))
